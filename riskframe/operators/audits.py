"""Data audits: coverage, repeatability, feasibility, availability, leakage and distributions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.prefix import settle, quantile_columns, running, time_range
from riskframe.functions.scalars import composition, safe_divide
from riskframe.operators.history import available, time_buckets


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def mark_covered(df: DataFrame, side: DataFrame, key: str, output: str = "covered") -> DataFrame:
    """Left join flag for a side table; no row is dropped or multiplied."""
    keys = side.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_hit", F.lit(1))
    return df.join(keys, key, "left").withColumn(output, F.coalesce("_hit", F.lit(0))).drop("_hit")


def join_coverage(df: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Covered and missing rows of a partially covering side table, in one row."""
    marked = mark_covered(df, side, key)
    return marked.agg(
        F.count("*").alias("rows"),
        F.sum("covered").cast("bigint").alias("covered_rows"),
        F.sum(1 - F.col("covered")).cast("bigint").alias("missing_rows"),
        F.avg("covered").alias("coverage_rate"),
        (1 - F.avg("covered")).alias("missing_rate"),
    )


def frequency_quantiles(counts: DataFrame, keys: Sequence[str], column: str, named: dict[str, float]) -> DataFrame:
    """Exact quantiles of a per-entity count; equal counts are merged before the exact percentile.

    A count column has few distinct values (their sum is the row count), so this stays bounded.
    """
    merged = counts.groupBy(*keys, column).agg(F.count("*").alias("_f"))
    return merged.groupBy(*keys).agg(*[F.percentile(F.col(column), F.lit(float(p)), F.col("_f")).alias(n) for n, p in named.items()])


def temporal_distribution(binned: DataFrame, cents: str, label: str, covered: str, time: str, bin_column: str = "time_bin") -> DataFrame:
    """Rows, positives, amounts and coverage per time bin."""
    whole = binned.groupBy(bin_column).agg(
        F.min(time).alias("min_time"), F.max(time).alias("max_time"), F.count("*").alias("rows"),
        F.sum(label).cast("bigint").alias("positives"), (F.avg(cents) / 100).alias("amount_mean"),
        F.sum(covered).cast("bigint").alias("covered_rows"), F.avg(label).alias("rate"), F.avg(covered).alias("coverage_rate"),
    )
    middle = quantile_columns(binned, [bin_column], cents, {"_m": 0.5})
    return whole.join(middle, bin_column).withColumn("amount_median", F.col("_m") / 100).drop("_m")


def entity_repeatability(df: DataFrame, entities: dict[str, Sequence[str]], time: str) -> DataFrame:
    """Coverage, repeat counts and time spans of each entity definition, one row each."""
    out = None
    for name, columns in entities.items():
        valid = available(columns)
        coverage = df.agg(
            F.count("*").alias("rows"), F.sum(valid.cast("bigint")).alias("valid_rows"), (1 - _share(valid)).alias("missing_ratio")
        ).withColumn("entity", F.lit(name))
        per = df.where(valid).groupBy(*columns).agg(F.count("*").alias("c"), (F.max(time) - F.min(time)).alias("span"))
        c = F.col("c")
        stats = per.agg(
            F.count("*").alias("entities"), F.avg(c).alias("mean_rows"), F.max(c).alias("max_rows"),
            _share(c == 1).alias("single_ratio"), _share(c >= 2).alias("ge2_ratio"), _share(c >= 5).alias("ge5_ratio"), _share(c >= 10).alias("ge10_ratio"),
            F.avg("span").alias("span_mean"),
        ).withColumn("entity", F.lit(name))
        tagged = per.withColumn("entity", F.lit(name))
        counts = frequency_quantiles(tagged, ["entity"], "c", {"median_rows": 0.5, "p90_rows": 0.9, "p95_rows": 0.95})
        spans = quantile_columns(tagged, ["entity"], "span", {"span_median": 0.5, "span_p90": 0.9})
        row = coverage.join(stats, "entity").join(counts, "entity").join(spans, "entity")
        out = row if out is None else out.unionByName(row)
    return out


def entity_coverage(placed: DataFrame, entities: dict[str, Sequence[str]], train: str = "train") -> DataFrame:
    """Future rows and unique entities already seen in train, per entity definition and split.

    Work is on (entity, split) counts, which already merge a hot entity's rows.
    """
    out = None
    for name, columns in entities.items():
        valid = available(columns)
        missing = placed.where(F.col("split") != train).groupBy("split").agg(
            F.count("*").alias("future_rows"), F.sum((~valid).cast("bigint")).alias("missing_rows")
        )
        counts = placed.where(valid).groupBy(*columns, "split").agg(F.count("*").alias("n"))
        seen = counts.where(F.col("split") == train).select(*columns, F.lit(1).alias("_seen"))
        future = counts.where(F.col("split") != train).join(seen, list(columns), "left").withColumn("_seen", F.coalesce("_seen", F.lit(0)))
        row = future.groupBy("split").agg(
            F.sum("n").alias("valid_rows"), F.sum(F.col("n") * F.col("_seen")).alias("seen_rows"),
            F.count("*").alias("unique_entities"), F.sum("_seen").cast("bigint").alias("seen_entities"),
        ).join(missing, "split").withColumns(
            {
                "entity": F.lit(name),
                "seen_row_ratio": safe_divide(F.col("seen_rows"), F.col("valid_rows")),
                "new_row_ratio": safe_divide(F.col("valid_rows") - F.col("seen_rows"), F.col("valid_rows")),
                "seen_entity_ratio": safe_divide(F.col("seen_entities"), F.col("unique_entities")),
            }
        )
        out = row if out is None else out.unionByName(row)
    return out


def history_feasibility(df: DataFrame, entities: dict[str, Sequence[str]], time: str, requirements: dict[str, int], span: int = 4096) -> DataFrame:
    """Rows with at least k strictly earlier rows of the same entity, per requirement."""
    out = None
    for name, columns in entities.items():
        buckets = time_buckets(df, columns, time).withColumn("_range", time_range(F.col(time), span))
        prior = running(buckets, columns, time, "_range", sums=["n"])
        asked = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(k).alias("required")) for f, k in requirements.items()]))
        enough = F.when(F.col("before_n") >= F.col("_r.required"), F.col("n")).otherwise(0)
        row = prior.withColumn("_r", asked).groupBy(F.col("_r.feature").alias("feature"), F.col("_r.required").alias("required")).agg(
            F.sum("n").alias("valid_rows"), F.sum(enough).cast("bigint").alias("sufficient_rows")
        ).withColumns({"entity": F.lit(name), "sufficient_ratio": safe_divide(F.col("sufficient_rows"), F.col("valid_rows"))})
        out = row if out is None else out.unionByName(row)
    return out


def entity_recommendation(repeatability: DataFrame, coverage: DataFrame, feasibility: DataFrame, feature: str, split: str = "test") -> DataFrame:
    """Entity with the highest product of availability, test coverage and feasibility."""
    c = coverage.where(F.col("split") == split).select("entity", "seen_row_ratio")
    f = feasibility.where(F.col("feature") == feature).select("entity", "sufficient_ratio")
    scored = repeatability.select("entity", "missing_ratio").join(c, "entity").join(f, "entity").withColumn(
        "product", (1 - F.col("missing_ratio")) * F.col("seen_row_ratio") * F.col("sufficient_ratio")
    )
    return scored.agg(F.max_by("entity", F.struct("product", "entity")).alias("entity"), F.max("product").alias("product"))


def _melted(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(list(keys), list(features), "feature", "value")


def feature_availability(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing rate and distribution of each feature."""
    long = _melted(df, [], features)
    whole = long.groupBy("feature").agg(
        F.count("*").alias("rows"), F.count("value").alias("present"), (1 - F.count("value") / F.count("*")).alias("missing_rate"),
        F.avg("value").alias("mean"), F.max("value").alias("max"),
    )
    return whole.join(quantile_columns(long, ["feature"], "value", {"median": 0.5, "p90": 0.9, "p95": 0.95}), "feature", "left")


def leakage_audit(features: DataFrame, granularities: dict[str, Sequence[str]], time: str, identity: str) -> DataFrame:
    """Structural checks of entity history as (check, prefix, violations).

    ``first_row_count_zero`` counts rows: an entity may have several at its first time, and each must have count 0.
    """
    out = None
    for prefix, columns in granularities.items():
        valid = features.where(available(columns))
        state = [f"{prefix}_{c}" for c in ("count", "mean", "std", "recency", "has_history", "has_std")]
        packed = F.struct(*state)
        cells = valid.groupBy(*columns, time).agg(
            F.min(packed).alias("_lo"), F.max(packed).alias("_hi"), F.sum((~F.col(f"{prefix}_count").eqNullSafe(0)).cast("bigint")).alias("_c")
        )
        same = cells.agg(F.sum((~F.col("_lo").eqNullSafe(F.col("_hi"))).cast("bigint")).alias("v"))
        first = cells.groupBy(*columns).agg(F.min_by("_c", time).alias("_first")).agg(F.sum("_first").alias("v"))
        strict = valid.agg(F.sum(((F.col(f"{prefix}_has_history") == 1) & ~F.coalesce(F.col(f"{prefix}_recency") > 0, F.lit(False))).cast("bigint")).alias("v"))
        core = F.lit(False)
        for c in ("count", "mean", "std", "ratio", "recency"):
            core = core | F.col(f"{prefix}_{c}").isNotNull()
        flags = (F.col(f"{prefix}_available") != 0) | (F.col(f"{prefix}_has_history") != 0) | (F.col(f"{prefix}_has_std") != 0)
        gone = features.agg(F.sum((~available(columns) & (core | flags)).cast("bigint")).alias("v"))
        for check, table in (("first_row_count_zero", first), ("same_time_identical", same), ("recency_positive", strict), ("unavailable_is_null", gone)):
            row = table.select(F.lit(check).alias("check"), F.lit(prefix).alias("prefix"), F.coalesce("v", F.lit(0)).alias("violations"))
            out = row if out is None else out.unionByName(row)
    doubled = features.groupBy(identity).agg(F.count("*").alias("_c")).agg(F.sum((F.col("_c") > 1).cast("bigint")).alias("v"))
    return out.unionByName(doubled.select(F.lit("ids_unique").alias("check"), F.lit("all").alias("prefix"), F.coalesce("v", F.lit(0)).alias("violations")))


def invariance_audit(df: DataFrame, build: Callable[[DataFrame], DataFrame], identity: str, time: str, label: str) -> DataFrame:
    """Rebuild features after a label flip, a reshuffle and a strictly later copy of the data.

    Features of the original rows must not change; counts of differing rows are returned.
    """
    base = build(df).drop(label)
    columns = [c for c in base.columns if c != identity]
    low, high = df.agg(F.min(time), F.max(time)).first()
    shift = high - low + 1
    later = df.withColumns({time: (F.col(time) + F.lit(shift)).cast(dict(df.dtypes)[time]), identity: -F.col(identity) - 1})
    worlds = {
        "label_flip": df.withColumn(label, 1 - F.col(label)),
        "shuffle": df.repartition(F.xxhash64(identity)),
        "future_append": df.unionByName(later),
    }
    digest = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    left = settle(base.select(identity, digest.alias("_a")))  # built once for the three comparisons
    out = None
    for name, world in worlds.items():
        right = build(world).drop(label).where(F.col(identity) >= 0).select(identity, digest.alias("_b"))
        row = left.join(right, identity, "full").agg(
            F.count("*").alias("rows"), F.sum((~F.col("_a").eqNullSafe(F.col("_b"))).cast("bigint")).alias("changed_rows")
        ).withColumn("test", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def distribution_by_fold(placed: DataFrame, cents: str, category: str, label: str = "label") -> DataFrame:
    """Amount statistics and category composition of every (fold, split)."""
    keys = ["fold", "split"]
    whole = placed.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(label).alias("rate"), (F.avg(cents) / 100).alias("amount_mean"))
    middle = quantile_columns(placed, keys, cents, {"_m": 0.5, "_p": 0.9}).select(
        *keys, (F.col("_m") / 100).alias("amount_median"), (F.col("_p") / 100).alias("amount_p90")
    )
    return whole.join(middle, keys).join(composition(placed, keys, category), keys)


def history_availability_by_fold(placed: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Entity availability and history shares per (fold, split, entity)."""
    keys = [c for c in ("fold", "split") if c in placed.columns]
    entries = F.array(
        *[F.struct(F.lit(p).alias("entity"), F.col(f"{p}_available").alias("a"), F.col(f"{p}_has_history").alias("h")) for p in prefixes]
    )
    a, h = F.col("_e.a"), F.col("_e.h")
    out = placed.withColumn("_e", F.explode(entries)).groupBy(*keys, F.col("_e.entity").alias("entity")).agg(
        F.count("*").alias("rows"), F.sum(a).cast("bigint").alias("available_rows"), F.sum(a * h).cast("bigint").alias("has_history_rows"),
        F.sum(a * (1 - h)).cast("bigint").alias("no_history_rows"),
    )
    return out.withColumns(
        {
            "availability_rate": safe_divide(F.col("available_rows"), F.col("rows")),
            "has_history_ratio": safe_divide(F.col("has_history_rows"), F.col("available_rows")),
            "no_history_ratio": safe_divide(F.col("no_history_rows"), F.col("available_rows")),
        }
    )


def cold_start(availability: DataFrame) -> DataFrame:
    """First-seen share in validation and test."""
    return availability.where(F.col("split").isin("validation", "test")).select(
        "fold", "split", "entity", "rows", "available_rows",
        F.col("no_history_rows").alias("first_seen_rows"), F.col("no_history_ratio").alias("first_seen_ratio"),
    )


def pair_repetition(df: DataFrame, a: str, b: str) -> DataFrame:
    """Frequency profile of (a, b) pairs in one row.

    Distinct counts come from the pair table, which is already smaller than the rows.
    """
    pairs = df.groupBy(a, b).agg(F.count("*").alias("f"))
    f = F.col("f")
    stats = pairs.agg(
        F.sum(f).alias("rows"), F.count("*").alias("pairs"), F.sum((f >= 2).cast("bigint")).alias("repeated_pairs"),
        F.sum(F.when(f >= 2, f).otherwise(0)).cast("bigint").alias("rows_in_repeated"), F.max(f).alias("max_frequency"), F.avg(f).alias("mean_frequency"),
        *[F.sum((f >= k).cast("bigint")).alias(f"pairs_ge_{k}") for k in (3, 5, 10)],
    ).withColumn("_k", F.lit(1))
    middle = frequency_quantiles(pairs.withColumn("_k", F.lit(1)), ["_k"], "f", {"median_frequency": 0.5, "p90_frequency": 0.9, "p99_frequency": 0.99})
    unique = pairs.select(F.lit(1).alias("_k"), F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col(a).cast("string").alias("v")), F.struct(F.lit("b").alias("s"), F.col(b).cast("string").alias("v")))).alias("e"))
    unique = unique.groupBy("_k", "e.s", "e.v").agg(F.lit(1).alias("_one")).groupBy("_k").agg(
        F.sum((F.col("s") == "a").cast("bigint")).alias("unique_a"), F.sum((F.col("s") == "b").cast("bigint")).alias("unique_b")
    )
    return stats.join(middle, "_k").join(unique, "_k").drop("_k").withColumns(
        {
            "repeated_pair_share": safe_divide(F.col("repeated_pairs"), F.col("pairs")),
            "repeated_row_share": safe_divide(F.col("rows_in_repeated"), F.col("rows")),
        }
    )


def feature_distribution(placed: DataFrame, features: Sequence[str], keys: Sequence[str] = ("fold", "split")) -> DataFrame:
    """Sparsity and distribution diagnostics per feature and partition.

    Values are counted first; every statistic, distinct counts included, reads those counts.
    """
    keys = [*keys, "feature"]
    long = _melted(placed, keys[:-1], features)
    counts = settle(long.groupBy(*keys, "value").agg(F.count("*").alias("n")))
    v, n = F.col("value"), F.col("n")
    some = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    out = counts.groupBy(*keys).agg(
        F.sum(n).alias("rows"), some(v.isNull()).alias("missing"), some(v == 0).alias("zero_rows"), some(v == 1).alias("one_rows"),
        some(v > 1).alias("above_one_rows"), F.count(v).alias("unique_values"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.sum(F.when(v.isNotNull(), n)).alias("_n"), F.sum(v * n).alias("_s"), F.sum(v * v * n).alias("_q"),
    )
    mean = F.col("_s") / F.col("_n")
    out = out.withColumns(
        {
            "mean": mean,
            "variance": F.greatest(F.lit(0.0), F.col("_q") / F.col("_n") - mean * mean),
            "zero_rate": safe_divide(F.col("zero_rows"), F.col("_n")),
            "probability_one": safe_divide(F.col("one_rows"), F.col("_n")),
            "probability_above_one": safe_divide(F.col("above_one_rows"), F.col("_n")),
            "missing_rate": safe_divide(F.col("missing"), F.col("rows")),
        }
    ).drop("_n", "_s", "_q")
    return out.join(quantile_columns(counts, keys, "value", {"median": 0.5, "p90": 0.9, "p99": 0.99}, weight="n"), keys, "left")


def partition_profile(placed: DataFrame, cents: str, category: str, values: Sequence[str], keys: Sequence[str] = ("fold", "split"), label: str = "label") -> DataFrame:
    """Class, amount and type shares of each partition, overall and among positives."""
    keys = list(keys)
    y = F.col(label)
    share = lambda v, among: safe_divide(F.sum((F.col(category) == v).cast("bigint") * (y if among else 1)), F.sum(y) if among else F.count("*"))
    return placed.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum(y).cast("bigint").alias("positives"), F.avg(y).alias("rate"),
        (F.avg(cents) / 100).alias("amount_mean"), (F.stddev_pop(cents) / 100).alias("amount_std"),
        (F.avg(F.when(y == 1, F.col(cents))) / 100).alias("amount_mean_positive"), (F.avg(F.when(y == 0, F.col(cents))) / 100).alias("amount_mean_negative"),
        *[share(v, False).alias(f"share_{v}") for v in values], *[share(v, True).alias(f"share_positive_{v}") for v in values],
    )


def split_profile(placed: DataFrame, time: str = "step", label: str = "label", keys: Sequence[str] = ("fold",)) -> DataFrame:
    """Rows, share of the fold, positives and time span per part."""
    keys = list(keys)
    parts = placed.groupBy(*keys, "split").agg(
        F.count("*").alias("rows"), F.sum(label).cast("bigint").alias("positives"), F.avg(label).alias("rate"),
        F.min(time).alias("min_time"), F.max(time).alias("max_time"), F.countDistinct(time).alias("times"),
    )
    whole = parts.groupBy(*keys).agg(F.sum("rows").alias("_all"))
    return parts.join(whole, keys).withColumn("fraction", safe_divide(F.col("rows"), F.col("_all"))).drop("_all")
