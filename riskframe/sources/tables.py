"""Sources and sinks: exact CSV ingest, label-free reads, ledgers and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.prefix import settle
from riskframe.functions.scalars import exact_cents
from riskframe.operators.checks import require_columns

TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("step", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("origin", T.LongType()),
        T.StructField("recipient", T.LongType()),
        T.StructField("label", T.IntegerType()),
    ]
)


def read_transactions_csv(spark: SparkSession, path: str, schema: T.StructType = TRANSACTION_SCHEMA, columns: Sequence[str] | None = None) -> DataFrame:
    """Header CSV under an explicit schema; a malformed line fails the read."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    return require_columns(df, columns or schema.fieldNames()).select(*(columns or schema.fieldNames()))


def ingest_exact(spark: SparkSession, path: str, columns: Sequence[str], amount: str = "amount", label: str = "label", step: str = "step") -> DataFrame:
    """Text CSV to exact cents with the record ordinal as ``source_row_id``; ``reject`` says why a row is bad.

    The ordinal is the row's place in its file split plus the rows of all earlier splits, so it does
    not depend on how many tasks read the file.
    """
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(text).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    placed = raw.select(
        *columns,
        F.monotonically_increasing_id().alias("_at"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    splits = placed.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per file split
    offsets = splits.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    cents = exact_cents(F.col(amount))
    blank = F.lit(False)
    for c in columns:
        blank = blank | F.col(c).isNull() | (F.trim(F.col(c)) == "")
    reject = (
        F.when(blank, "empty field")
        .when(~F.col(label).isin("0", "1"), "label")
        .when(~F.col(step).rlike("^[0-9]{1,9}$"), "step")
        .when(cents.isNull(), "amount")
    )
    return placed.join(offsets, ["_file", "_block"]).select(
        (F.col("_offset") + F.col("_at") - F.col("_first")).alias("source_row_id"),
        *columns,
        cents.alias("amount_cents"),
        reject.alias("reject"),
    )


def accepted(df: DataFrame) -> DataFrame:
    """Ingested rows, or an error naming the first reasons for rejection."""
    bad = df.where(F.col("reject").isNotNull()).groupBy("reject").count().limit(10).collect()
    if bad:
        raise ValueError(f"rejected rows: {[tuple(r) for r in bad]}")
    return df.drop("reject")


def read_label_free(df: DataFrame, label: str, order: Sequence[str] = ()) -> DataFrame:
    """Every column but the label, which column pruning then keeps out of the scan."""
    kept = df.drop(label)
    return kept.orderBy(*order) if order else kept


def read_labels_for_ids(df: DataFrame, permitted: DataFrame, key: str, label: str) -> DataFrame:
    """Labels of the permitted ids only."""
    return df.select(key, label).join(permitted.select(key), key, "left_semi")


def write_features(df: DataFrame, path: str, time: str, partitions: int | None = None) -> None:
    """Parquet (zstd), range-partitioned and sorted by time, so time filters skip row groups."""
    ranged = df.repartitionByRange(partitions, time) if partitions else df.repartitionByRange(time)
    ranged.sortWithinPartitions(time).write.mode("overwrite").parquet(path, compression="zstd")


#: Rows of one grid cell that one file of a ledger should hold.
FILE_ROWS = 5_000_000


def write_ledger(df: DataFrame, path: str, by: Sequence[str] = ("fold", "seed", "model")) -> None:
    """Prediction ledger partitioned by its grid; a cell is dealt out by id over as many tasks as its rows ask for."""
    cells = settle(df.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(FILE_ROWS)).alias("_files")))
    counted = df.join(cells.select(*[F.col(b).alias(f"_{b}") for b in by], "_files"), [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    dealt = counted.withColumn("_file", F.pmod(F.xxhash64("id"), "_files"))
    spread = dealt.repartition(*by, "_file").select(*df.columns)
    spread.write.mode("overwrite").partitionBy(*by).parquet(path, compression="zstd")


def read_ledger(spark: SparkSession, path: str, columns: Sequence[str] | None = None, **cell) -> DataFrame:
    """Filtered, projected ledger scan: grid filters prune partitions."""
    df = spark.read.parquet(path)
    for name, value in cell.items():
        df = df.where(F.col(name) == value)
    return df.select(*columns) if columns else df


def paired_ledger(base: DataFrame, candidate: DataFrame, keys: Sequence[str] = ("fold", "seed", "id"), shared: Sequence[str] = ("time", "label"), fields: Sequence[str] = ("raw", "platt", "alert")) -> DataFrame:
    """One row per id with the scores and decisions of both models."""
    a = base.select(*keys, *shared, *[F.col(c).alias(f"base_{c}") for c in fields])
    b = candidate.select(*keys, *[F.col(c).alias(f"candidate_{c}") for c in fields])
    return a.join(b, list(keys))


def write_paired_ledger(base: DataFrame, candidate: DataFrame, path: str, **options) -> None:
    write_ledger(paired_ledger(base, candidate, **options), path, by=("fold", "seed"))


def combine_checkpoints(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per-task outputs as one table, each row tagged with its task's place in ``paths``."""
    out = None
    for i, p in enumerate(paths):
        part = spark.read.parquet(p).withColumn("task", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Result table as CSV or JSON files, as many as its size asks for (one if it is small)."""
    if fmt not in ("csv", "json"):
        raise ValueError("fmt must be csv or json")
    writer = df.hint("rebalance").write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)
