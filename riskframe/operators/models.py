"""Model fitting on pyspark.ml, scoring, selection and inspection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.features import leakage_guard
from riskframe.operators.encode import tree_pipeline
from riskframe.session import shared_dir


#: From this depth on a row's walk down a tree costs more than remembering its node.
DEEP = 8


def _weighted(df: DataFrame, label: str, positive_weight: float) -> DataFrame:
    return df.withColumns(
        {"_y": F.col(label).cast("double"), "_w": F.when(F.col(label) == 1, F.lit(float(positive_weight))).otherwise(F.lit(1.0))}
    )


def fit_gbt(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, seed: int = 42, positive_weight: float = 1.0,
    trees: int = 20, depth: int = 5, step: float = 0.1, subsample: float = 0.8,
) -> PipelineModel:
    """Weighted boosted trees behind the tree encoding. Long boosting chains are cut by checkpoints.

    The node of a row is remembered only in deep trees: in shallow ones each level would write and
    cache a table of all rows to save a walk of a few steps. The trees are the same.
    """
    leakage_guard([*numeric, *categorical], df.columns)
    shared_dir(df.sparkSession)
    encoder = tree_pipeline(numeric, categorical).fit(df)
    matrix = _weighted(encoder.transform(df), label, positive_weight).select("features", "_y", "_w")
    tree = GBTClassifier(
        labelCol="_y", weightCol="_w", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=seed, checkpointInterval=10,
        cacheNodeIds=depth > DEEP,
    ).fit(matrix)
    return PipelineModel([*encoder.stages, tree])


@dataclass
class LogisticFit:
    """A logistic model, whether it converged, and its attempts as (limit, iterations)."""

    model: PipelineModel
    converged: bool
    attempts: list[tuple[int, int]]


def fit_logistic(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, positive_weight: float = 1.0, limits: Sequence[int] = (100, 400),
    penalty: float = 1e-4,
) -> LogisticFit:
    """Logistic regression with one longer retry; a fit that still hits its limit is not used for inference."""
    leakage_guard([*numeric, *categorical], df.columns)
    encoder = tree_pipeline(numeric, categorical).fit(df)
    matrix = _weighted(encoder.transform(df), label, positive_weight).select("features", "_y", "_w").persist()
    attempts, model = [], None
    try:
        for limit in limits:
            model = LogisticRegression(labelCol="_y", weightCol="_w", maxIter=limit, regParam=penalty, standardization=True, tol=1e-8).fit(matrix)
            attempts.append((limit, int(model.summary.totalIterations)))
            if attempts[-1][1] < limit:
                break
    finally:
        matrix.unpersist()
    return LogisticFit(PipelineModel([*encoder.stages, model]), attempts[-1][1] < attempts[-1][0], attempts)


def score(model: PipelineModel, df: DataFrame, output: str = "raw", margin: bool = False) -> DataFrame:
    """Probability of the positive class, or its raw margin."""
    out = model.transform(df)
    value = vector_to_array(F.col("rawPrediction" if margin else "probability"))[1]
    return out.select(*df.columns, value.alias(output))


def run_grid(
    placed: DataFrame,
    schemes: dict[str, dict],
    seeds: Sequence[int],
    label: str,
    identity: str,
    fit: Callable[..., PipelineModel] = fit_gbt,
    folds: Sequence[int] = (1,),
) -> DataFrame:
    """Fit on train, score validation and test, for each (fold, scheme, seed): one long ledger.

    The loop is over grid cells only; every cell is a set of Spark jobs. Only columns that some scheme names
    are kept in memory. All models of a fold score a row together, in one read of it.
    """
    named = list(dict.fromkeys(c for options in schemes.values() for kind in ("numeric", "categorical") for c in options.get(kind, ())))
    out = None
    for fold in folds:
        part = placed.where(F.col("fold") == fold)
        train = part.where(F.col("split") == "train").select(label, *named).persist()
        scored, cells = part.where(F.col("split") != "train").select("split", identity, label, *named), []
        try:
            for name, options in schemes.items():
                for seed in seeds:
                    column = f"_raw_{len(cells)}"
                    scored = score(fit(train, label=label, seed=seed, **options), scored, column)
                    cells.append(F.struct(F.lit(name).alias("model"), F.lit(seed).alias("seed"), F.col(column).alias("raw")))
        finally:
            train.unpersist()
        long = scored.withColumn("_c", F.explode(F.array(*cells)))
        rows = long.select(
            F.lit(fold).alias("fold"), "split", "_c.model", "_c.seed", F.col(identity).alias("id"), F.col(label).alias("label"), "_c.raw"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def choose_candidate(grid: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """Most true positives, then AP, then fewer trees, then the smaller id; an incomplete grid chooses nothing."""
    order = F.struct(-F.col("tp"), -F.col("ap"), F.col("trees"), F.col("candidate"))
    complete = F.count("*") == expected
    return grid.groupBy(*keys).agg(
        F.when(complete, F.min_by(F.struct("candidate", "tp", "ap", "trees"), order)).alias("_c")
    ).where(F.col("_c").isNotNull()).select(*keys, "_c.*")


def select_by_validation(results: DataFrame, keys: Sequence[str], name: str, cost: str) -> DataFrame:
    """Cheapest name per key on validation; equal costs go to the smaller name."""
    return results.groupBy(*keys).agg(F.min_by(name, F.struct(F.col(cost), F.col(name))).alias(name), F.min(cost).alias(cost))


def importance_rank(model: PipelineModel, encoded: DataFrame) -> DataFrame:
    """Gain importance of every encoded column: value, share and minimum rank.

    Encoded names come from the vector column's metadata; the table is as long as the model is wide.
    """
    gains = model.stages[-1].featureImportances.toArray()
    attributes = encoded.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for kind in attributes.values() for a in kind}
    rows = [(names.get(i, f"f{i}"), float(g)) for i, g in enumerate(gains)]
    table = encoded.sparkSession.createDataFrame(rows, "feature string, gain double")
    total = sum(g for _, g in rows) or 1.0
    return table.select("feature", "gain", (F.col("gain") / F.lit(total)).alias("share"), F.rank().over(Window.orderBy(F.desc("gain"))).alias("gain_rank"))


def failure_cases(df: DataFrame, score_column: str, label: str, ties: Sequence[str], k: int = 200) -> DataFrame:
    """The k largest absolute errors (a top-k report), ``ties`` (an id and its cell) breaking ties."""
    gap = F.abs(F.col(label) - F.col(score_column))
    return df.withColumn("absolute_error", gap).orderBy(F.desc("absolute_error"), *ties).limit(k)


def balanced_sample(df: DataFrame, n: int, label: str, identity: str, seed: int = 42) -> DataFrame:
    """Sampling operator: up to n/2 positives, filled up with negatives, in hashed order."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(identity)), 256)
    keyed = df.withColumn("_h", order)
    positives = keyed.where(F.col(label) == 1).orderBy("_h", identity).limit(n // 2)
    count = positives.count()
    negatives = keyed.where(F.col(label) == 0).orderBy("_h", identity).limit(n - count)
    return positives.unionByName(negatives).drop("_h")


def inclusion_trace(train: DataFrame, encoded: DataFrame, features: Sequence[str], used: Sequence[str]) -> DataFrame:
    """Is each feature in the data, in the declared set and in the encoded vector; and does it vary?"""
    attributes = encoded.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["name"] for kind in attributes.values() for a in kind}
    there = [f for f in features if f in train.columns]
    long = train.select(*[F.col(f).cast("double").alias(f) for f in there]).unpivot([], there, "feature", "value")
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    v, n = F.col("value"), F.col("n")
    mean = F.sum(v * n) / F.sum(F.when(v.isNotNull(), n))
    stats = counts.groupBy("feature").agg(
        (F.sum(F.when(v.isNull(), n).otherwise(0)) / F.sum(n)).alias("missing_rate"),
        (F.sum(F.when(F.coalesce(v, F.lit(0.0)) != 0, n).otherwise(0)) / F.sum(n)).alias("nonzero_rate"),
        F.count(v).alias("unique_count"),
        (F.sum(v * v * n) / F.sum(F.when(v.isNotNull(), n)) - mean * mean).alias("variance"),
    )
    flags = train.sparkSession.createDataFrame(
        [(f, int(f in train.columns), int(f in used), int(f in names)) for f in features],
        "feature string, in_data int, in_set int, in_encoded int",
    )
    return flags.join(stats, "feature", "left")
