"""Time-respecting splits: every boundary falls between two distinct times.

Rows are counted per time first. Boundaries are then chosen on that table by ``min_by`` and joined
back to the rows as a table of a few ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.prefix import running, time_range


def time_grid(df: DataFrame, time: str, label: str | None = None, keys: Sequence[str] = (), span: int = 4096) -> DataFrame:
    """Per distinct time: rows, positives, position 1..T, cumulative rows, and whole totals."""
    keys = list(keys)
    pos = F.sum(F.col(label).cast("bigint")) if label else F.lit(0).cast("bigint")
    counted = df.groupBy(*keys, time).agg(F.count("*").alias("n"), pos.alias("pos"))
    ranged = counted.withColumn("_one", F.lit(1).cast("bigint")).withColumn("_range", time_range(F.col(time), span))
    out = running(ranged, keys, time, "_range", sums=["n", "pos", "_one"], totals=True)
    return out.select(
        *keys,
        time,
        "n",
        "pos",
        (F.col("before__one") + 1).alias("position"),
        (F.col("before_n") + F.col("n")).alias("cum_rows"),
        (F.col("before_pos") + F.col("pos")).alias("cum_pos"),
        F.col("total_n").alias("rows"),
        F.col("total_pos").alias("positives"),
        F.col("total__one").alias("groups"),
    )


def _nearest(target):
    distance = F.abs(F.col("cum_rows") - target)
    return F.min_by("position", F.struct(distance, F.col("position")))


def nearest_boundary(df: DataFrame, time: str, fraction: float, low: int = 1, high_offset: int = 0) -> DataFrame:
    """Position whose cumulative rows lie closest to ``fraction`` of all rows; the first on ties."""
    grid = time_grid(df, time)
    legal = grid.where((F.col("position") >= low) & (F.col("position") <= F.col("groups") - high_offset))
    at = legal.agg(_nearest(F.col("rows") * F.lit(float(fraction))).alias("position"))
    return grid.join(at, "position").select("position", F.col(time).alias("last_time"), "cum_rows")


def rolling_boundaries(
    df: DataFrame,
    folds: int = 3,
    initial: float = 0.4,
    validation: float = 0.1,
    test: float = 0.1,
    time: str = "step",
) -> DataFrame:
    """Expanding walk-forward folds: rows (fold, split, start_time, end_time)."""
    if folds < 2 or min(initial, validation, test) <= 0 or initial + validation + test > 1:
        raise ValueError("need two folds and positive fractions that sum to at most one")
    shift = (1 - (initial + validation + test)) / (folds - 1)
    goals = []
    for f in range(folds):
        a = initial + f * shift
        b = a + validation
        goals.append(
            F.struct(
                F.lit(f + 1).alias("fold"),
                F.lit(a).alias("fa"),
                F.lit(b).alias("fb"),
                F.lit(min(b + test, 1.0)).alias("fc"),
            )
        )
    grid = time_grid(df, time).withColumn("_g", F.explode(F.array(*goals))).select("*", "_g.*").drop("_g")
    p, groups, rows = F.col("position"), F.col("groups"), F.col("rows")
    first = grid.where(p <= groups - 2).groupBy("fold").agg(_nearest(rows * F.col("fa")).alias("ia"))
    second = (
        grid.join(first, "fold")
        .where((p >= F.col("ia") + 1) & (p <= groups - 1))
        .groupBy("fold", "ia")
        .agg(_nearest(rows * F.col("fb")).alias("ib"))
    )
    third = (
        grid.join(second, "fold")
        .where(p >= F.col("ib") + 1)
        .groupBy("fold", "ia", "ib")
        .agg(_nearest(rows * F.col("fc")).alias("ic"))
    )
    part = F.when(p <= F.col("ia"), "train").when(p <= F.col("ib"), "validation").otherwise("test")
    return (
        grid.join(third, "fold")
        .where(p <= F.col("ic"))
        .groupBy("fold", part.alias("split"))
        .agg(F.min(time).alias("start_time"), F.max(time).alias("end_time"))
    )


BOUNDARY_SCHEMA = T.StructType(
    [
        T.StructField("fold", T.IntegerType(), False),
        T.StructField("split", T.StringType(), False),
        T.StructField("start_time", T.LongType(), False),
        T.StructField("end_time", T.LongType(), False),
    ]
)


def apply_boundaries(df: DataFrame, boundaries: DataFrame, time: str = "step") -> DataFrame:
    """Rows with their fold and split; a row appears once per fold that covers it.

    ``boundaries`` holds three rows per fold. They are gathered per fold count, not per data, and
    become one literal array, so the range lookup is a projection without a join.
    """
    stored = sorted(tuple(r) for r in boundaries.select("fold", "split", "start_time", "end_time").collect())
    for fold in {b[0] for b in stored}:
        ranges = sorted((b[2], b[3]) for b in stored if b[0] == fold)
        if any(a[1] >= b[0] for a, b in zip(ranges, ranges[1:])):
            raise ValueError(f"boundaries of fold {fold} overlap")
    entries = [
        F.struct(F.lit(f).alias("fold"), F.lit(s).alias("split"), F.lit(a).alias("a"), F.lit(b).alias("b"))
        for f, s, a, b in stored
    ]
    t = F.col(time)
    hits = F.filter(F.array(*entries), lambda e: (t >= e["a"]) & (t <= e["b"]))
    return df.withColumn("_b", F.explode(hits)).select("*", F.col("_b.fold").alias("fold"), F.col("_b.split").alias("split")).drop("_b")


def verify_counts(placed: DataFrame, expected: DataFrame) -> DataFrame:
    """Stored against found row counts per (fold, split); equal everywhere when the data fits."""
    found = placed.groupBy("fold", "split").agg(F.count("*").alias("found_rows"))
    return expected.join(found, ["fold", "split"], "full").withColumn(
        "matches", F.coalesce(F.col("rows") == F.col("found_rows"), F.lit(False))
    )


def rolling_splits(df: DataFrame, time: str = "step", **options) -> DataFrame:
    return apply_boundaries(df, rolling_boundaries(df, time=time, **options), time)


def temporal_boundaries(
    df: DataFrame, train: float = 0.6, validation: float = 0.2, mode: str = "time_fraction", time: str = "step"
) -> DataFrame:
    """One three-way split, by share of rows or by share of distinct times."""
    if train <= 0 or validation <= 0 or train + validation >= 1:
        raise ValueError("fractions must be positive and leave a test part")
    grid = time_grid(df, time)
    p, groups, rows = F.col("position"), F.col("groups"), F.col("rows")
    if mode == "time_fraction":
        first = F.greatest(F.lit(1), F.floor(groups * F.lit(train)))
        second = F.least(F.greatest(first + 1, F.floor(groups * F.lit(train + validation))), groups - 1)
        placed = grid.withColumns({"ia": first, "ib": second})
    elif mode == "row_fraction":
        ia = grid.where(p <= groups - 2).agg(_nearest(rows * F.lit(train))).first()[0]
        ib = grid.where((p > ia) & (p <= groups - 1)).agg(_nearest(rows * F.lit(train + validation))).first()[0]
        placed = grid.withColumns({"ia": F.lit(ia), "ib": F.lit(ib)})
    else:
        raise ValueError("mode must be row_fraction or time_fraction")
    part = F.when(p <= F.col("ia"), "train").when(p <= F.col("ib"), "validation").otherwise("test")
    return placed.groupBy(F.lit(1).alias("fold"), part.alias("split")).agg(
        F.min(time).alias("start_time"), F.max(time).alias("end_time")
    )


def temporal_split(df: DataFrame, time: str = "step", **options) -> DataFrame:
    return apply_boundaries(df, temporal_boundaries(df, time=time, **options), time).drop("fold")


def calibration_threshold_boundaries(df: DataFrame, time: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cut nearest half the rows such that both parts hold both classes; the earlier on ties."""
    grid = time_grid(df, time, label, keys)
    before_neg = F.col("cum_rows") - F.col("cum_pos")
    after_pos = F.col("positives") - F.col("cum_pos")
    after_neg = F.col("rows") - F.col("positives") - before_neg
    feasible = (F.col("cum_pos") > 0) & (before_neg > 0) & (after_pos > 0) & (after_neg > 0)
    chosen = grid.where((F.col("position") < F.col("groups")) & feasible)
    distance = F.abs(F.col("cum_rows") - F.col("rows") / F.lit(2.0))
    return chosen.groupBy(*keys).agg(
        F.min_by(F.struct("position", time, "cum_rows"), F.struct(distance, F.col("position"))).alias("b")
    ).select(*keys, F.col("b.position").alias("boundary"), F.col(f"b.{time}").alias("last_time"), F.col("b.cum_rows").alias("first_rows"))


def fixed_splits(df: DataFrame, ranges: dict[str, tuple[int, int]], time: str = "step") -> DataFrame:
    """Declared inclusive time ranges; a row in none of them gets a null split."""
    part = F.lit(None).cast("string")
    for name, (low, high) in ranges.items():
        part = F.when(F.col(time).between(low, high), F.lit(name)).otherwise(part)
    return df.withColumn("split", part)


def require_assigned(df: DataFrame) -> DataFrame:
    if df.where(F.col("split").isNull()).limit(1).count():
        raise ValueError("some rows lie outside every declared range")
    return df


def split_summary(placed: DataFrame, time: str = "step", label: str = "label") -> DataFrame:
    """Start, end, rows, positives and rate per (fold, split)."""
    return placed.groupBy("fold", "split").agg(
        F.min(time).alias("start_time"),
        F.max(time).alias("end_time"),
        F.count("*").alias("rows"),
        F.sum(label).cast("bigint").alias("positives"),
        F.avg(label).alias("rate"),
    )


def audit_split(df: DataFrame, time: str = "step", label: str = "label") -> DataFrame:
    """70/15/15 row split with its summary."""
    bounds = temporal_boundaries(df, 0.70, 0.15, "row_fraction", time)
    return split_summary(apply_boundaries(df, bounds, time), time, label).drop("fold")


def validate_folds(df: DataFrame, placed: DataFrame, time: str = "step") -> DataFrame:
    """Order, time isolation, forward motion and final coverage as (check, fold, violations)."""
    ends = placed.groupBy("fold").pivot("split", ["train", "validation", "test"]).agg(
        F.min(time).alias("lo"), F.max(time).alias("hi")
    )
    order = ends.select(
        F.lit("strict_time_order").alias("check"),
        "fold",
        (~((F.col("train_hi") < F.col("validation_lo")) & (F.col("validation_hi") < F.col("test_lo")))).cast("bigint").alias("violations"),
    )
    shared = placed.groupBy("fold", time).agg((F.countDistinct("split") > 1).cast("bigint").alias("bad"))
    isolation = shared.groupBy("fold").agg(F.sum("bad").alias("violations")).select(
        F.lit("time_isolation").alias("check"), "fold", "violations"
    )
    later = ends.select((F.col("fold") + 1).alias("fold"), *[F.col(f"{s}_hi").alias(f"prev_{s}") for s in ("train", "validation", "test")])
    forward = ends.join(later, "fold").select(
        F.lit("forward_motion").alias("check"),
        "fold",
        (
            ~(
                (F.col("train_hi") > F.col("prev_train"))
                & (F.col("validation_hi") > F.col("prev_validation"))
                & (F.col("test_hi") > F.col("prev_test"))
            )
        ).cast("bigint").alias("violations"),
    )
    last, low, high = ends.select("fold", "train_lo", "test_hi").orderBy(F.desc("fold")).first()
    outside = F.coalesce(F.sum((~F.col(time).between(low, high)).cast("bigint")), F.lit(0))
    coverage = df.agg(outside.alias("violations")).select(
        F.lit("final_coverage").alias("check"), F.lit(last).alias("fold"), "violations"
    )
    return order.unionByName(isolation).unionByName(forward).unionByName(coverage)


def time_bins(df: DataFrame, bins: int, time: str = "step") -> DataFrame:
    """Equal-width right-closed bins 1..n; the lowest value falls into the first."""
    low, high = df.agg(F.min(time), F.max(time)).first()
    if low is None or low >= high:
        raise ValueError("time must span more than one value")
    place = F.ceil((F.col(time) - F.lit(low)) * F.lit(bins) / F.lit(float(high - low)))
    return df.withColumn("time_bin", F.greatest(F.lit(1), F.least(F.lit(bins), place)).cast("int"))


def segments(df: DataFrame, ranges: dict[str, tuple[int, int]], time: str = "time") -> DataFrame:
    """Copy each row into every evaluation segment whose inclusive range covers it."""
    entries = [F.struct(F.lit(n).alias("s"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in ranges.items()]
    t = F.col(time)
    return df.withColumn("segment", F.explode(F.transform(F.filter(F.array(*entries), lambda e: (t >= e["a"]) & (t <= e["b"])), lambda e: e["s"])))
