"""Cardinality-checked joins and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _repeats(df: DataFrame, keys: Sequence[str]) -> int:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1).limit(1).count()


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join that must not multiply left rows: a repeated right key is an error."""
    if _repeats(right, keys):
        raise ValueError(f"right side repeats a key of {list(keys)}")
    return left.join(right, list(keys), how)


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    if _repeats(left, keys) or _repeats(right, keys):
        raise ValueError(f"a side repeats a key of {list(keys)}")
    return left.join(right, list(keys), how)


def full_with_indicator(left: DataFrame, right: DataFrame, keys: Sequence[str], indicator: str = "match") -> DataFrame:
    """Full outer join with ``both``, ``left_only`` or ``right_only`` per row."""
    joined = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), list(keys), "full")
    mark = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return joined.withColumn(indicator, mark).drop("_l", "_r")


def membership(df: DataFrame, other: DataFrame, keys: Sequence[str], output: str = "member") -> DataFrame:
    """Flag rows whose key occurs in ``other``."""
    seen = other.select(*keys).distinct().withColumn("_m", F.lit(1))
    return df.join(seen, list(keys), "left").withColumn(output, F.coalesce("_m", F.lit(0))).drop("_m")


def weighted_totals(totals: DataFrame, draws: DataFrame, on: Sequence[str], by: Sequence[str], values: Sequence[str], weight: str = "mult") -> DataFrame:
    """Sparse product of weights and group totals: sum(weight * value) per ``by``."""
    return totals.join(draws, list(on)).groupBy(*by).agg(*[F.sum(F.col(weight) * F.col(v)).alias(v) for v in values])


def pivot_join(facts: DataFrame, long: DataFrame, key: Sequence[str], names: str, values: Sequence[str], value: str) -> DataFrame:
    """Lay a long table out by name and join it to the facts."""
    wide = long.groupBy(*key).pivot(names, list(values)).agg(F.first(value))
    return facts.join(wide, list(key))


def union_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of every frame, columns matched by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def set_partition(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct ids with their side: in both, only in a, only in b. One shuffle serves intersect and difference."""
    both = a.select(*key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    side = F.when((F.max("_a") == 1) & (F.max("_b") == 1), "both").when(F.max("_a") == 1, "only_a").otherwise("only_b")
    return both.groupBy(*key).agg(side.alias("side"))


def shared_times(placed: DataFrame, time: str) -> DataFrame:
    """Times that occur in more than one split of a fold; empty when the splits are disjoint."""
    return placed.groupBy("fold", time).agg(F.countDistinct("split").alias("splits")).where(F.col("splits") > 1)
