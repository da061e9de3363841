"""Named, leakage-safe feature column sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns that must never enter a model.
FORBIDDEN = frozenset({"id", "source_row_id", "origin", "recipient", "label", "type_label", "step", "time", "fold", "split"})


def tagged_features(windows: Sequence[int] = (1, 6, 24)) -> dict[str, str]:
    """Every feature column and what it tells: the payment, its time, how often, how much, with whom."""
    tells = {"count": "often", "distinct": "often", "mean": "much", "max": "much", "std": "much", "ratio": "much", "pair": "whom"}
    windowed = {f"{name}_{w}": tag for tag in ("often", "much", "whom") for w in windows for name, t in tells.items() if t == tag}
    return {"amount_cents": "payment", "hour_of_day": "time", "day_index": "time", "recency": "often", **windowed}


#: Named sets by the tags they take.
SET_TAGS = {
    "base": {"payment"},
    "calendar": {"payment", "time"},
    "frequency": {"payment", "time", "often"},
    "amount": {"payment", "time", "much"},
    "full": {"payment", "time", "often", "much"},
    "full_with_pair": {"payment", "time", "often", "much", "whom"},
}


def feature_sets(windows: Sequence[int] = (1, 6, 24)) -> dict[str, list[str]]:
    """Column list of each named set."""
    tagged = tagged_features(windows)
    return {name: [c for c, tag in tagged.items() if tag in tags] for name, tags in SET_TAGS.items()}


def entity_sets(raw: Sequence[str], prefixes: Sequence[str] = ("card", "combo")) -> dict[str, list[str]]:
    """Raw columns alone, and with the history of each entity granularity."""
    core = ("available", "count", "mean", "std", "ratio", "recency", "distinct", "has_history", "has_std")
    return {"raw": list(raw), **{f"raw_{p}": [*raw, *[f"{p}_{c}" for c in core]] for p in prefixes}}


def leakage_guard(columns: Sequence[str], present: Sequence[str], forbidden=FORBIDDEN) -> list[str]:
    """Reject forbidden, repeated or missing feature columns."""
    columns = list(columns)
    leaking = sorted(set(columns) & set(forbidden))
    if leaking:
        raise ValueError(f"leaking feature columns: {leaking}")
    if len(set(columns)) != len(columns):
        raise ValueError("repeated feature columns")
    missing = sorted(set(columns) - set(present))
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return columns


def feature_group(df: DataFrame, name: str, keep: Sequence[str] = (), sets: dict[str, list[str]] | None = None) -> DataFrame:
    """Project to a named set, with ``keep`` columns (ids, label) carried in front."""
    columns = (sets or feature_sets())[name]
    return df.select(*keep, *leakage_guard(columns, df.columns))


def label_dependence(
    rows: DataFrame, build: Callable[[DataFrame], DataFrame], columns: Sequence[str], times: Sequence[int], label: str = "label", time: str = "step", identity: str = "id"
) -> DataFrame:
    """Do features of a time know labels of that time or later? (feature, at, rows, changed, rejected)

    ``build`` makes the features of ``rows``. For every time asked, it makes them again with all labels from
    that time on turned round; features of rows up to that time must not move. ``changed`` counts those that do.
    Features may draw on earlier labels as they like. ``identity`` must be unique.
    """
    def valued(df: DataFrame, at: int) -> DataFrame:
        hashed = [F.xxhash64(F.col(c)).alias(c) for c in columns]
        return build(df).where(F.col(time) <= at).select(identity, *hashed).unpivot([identity], list(columns), "feature", "value")

    out = None
    for at in times:
        turned = rows.withColumn(label, F.when(F.col(time) >= at, 1 - F.col(label)).otherwise(F.col(label)))
        both = valued(rows, at).join(valued(turned, at).withColumnRenamed("value", "again"), [identity, "feature"], "full")
        moved = (~F.col("value").eqNullSafe(F.col("again"))).cast("bigint")
        found = both.groupBy("feature").agg(F.lit(at).alias("at"), F.count("*").alias("rows"), F.sum(moved).alias("changed"))
        out = found if out is None else out.unionByName(found)
    return out.withColumn("rejected", (F.col("changed") > 0).cast("int"))
