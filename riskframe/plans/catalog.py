"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.history import range_history_exact
from riskframe.operators.splits import temporal_split
from riskframe.plans import canon
from riskframe.plans import q_audits, q_bootstrap, q_checks, q_effects, q_faults, q_history, q_models, q_scores, q_splits, q_streaming  # noqa: F401
from riskframe.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = range_history_exact(canon.tx(spark, sf_dir), windows=(24,))
    placed = temporal_split(rows, train=0.6, validation=0.2, mode="row_fraction")
    return placed.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.sum((F.col("count_24") > 0).cast("bigint")).alias("with_history"),
        F.round(F.avg("count_24"), 6).alias("mean_count"),
        F.round(F.avg("mean_24"), 6).alias("mean_amount"),
    )
