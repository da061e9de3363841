"""Corpus pipeline: quality filter, exact and near deduplication, mixing, token encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes
what a stage returns as Parquet to the shared folder and reads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import crc_fold, stored, table
from riskframe.llm.exact_dedup import keep_one
from riskframe.llm.mixing import mix_sources, taken_documents
from riskframe.llm.pieces import token_digests
from riskframe.llm.quality import fit_quality, score_quality
from riskframe.llm.queries import piece_model
from riskframe.llm.simhash import near_duplicates

GOOD = 0.7


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least ``GOOD``; it is fitted on the table's documents, held-out ones aside."""
    net = fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=crc_fold("doc_id", 4) != 2)
    return score_quality(docs, net, output="_quality_score").where(F.col("_quality_score") >= GOOD).drop("_quality_score")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return keep_one(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document with the smallest doc_id (null ids stay only where a group has no other)."""
    stays = near_duplicates(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["_stays"]), "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to twice, or not at all."""
    return taken_documents(docs, mix_sources(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return token_digests(docs, piece_model())


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix),
    ("encode_pieces", encode),
]

#: Classifier, rounding draws and tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
