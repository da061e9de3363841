"""Strictly-past history features.

One rule holds everywhere: a row sees only rows with a smaller time; rows sharing a time never see
each other, and a window of width w reaches from time-w to time-1, both ends included.

Rows are first summed into (entity, time) buckets with map-side combine, so a hot entity shrinks
from its rows to its distinct times. Bounded windows are then taken inside (entity, time range)
groups, each bucket being copied into the following ranges its window reaches; unbounded history
uses two-level running sums. Either way one entity is spread over many tasks, with exact results.
Merchant history is for entities whose rows seldom share a time, where buckets save nothing: its rows move once, into such
groups, and get their windows there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.prefix import default_ranges, running, time_range
from riskframe.functions.scalars import (
    day_index,
    hour_of_day,
    ratio_offset,
    ratio_or_zero,
    std_from_moments,
)

SQUARE = "decimal(38,0)"


def available(columns: Sequence[str]) -> Column:
    """An entity exists only where every component is present."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def time_buckets(df: DataFrame, entity: Sequence[str], time: str, cents: str | None = None) -> DataFrame:
    """Count and exact integer moments per (entity, time)."""
    known = df.where(available(entity))
    aggregates = [F.count("*").alias("n")]
    if cents:
        wide = F.col(cents).cast("decimal(19,0)")
        aggregates += [
            F.sum(cents).alias("s"),
            F.sum((wide * wide).cast(SQUARE)).alias("ss"),
            F.max(cents).alias("mx"),
        ]
    return known.groupBy(*entity, time).agg(*aggregates)


def range_windows(
    buckets: DataFrame,
    entity: Sequence[str],
    time: str,
    windows: Sequence[int],
    columns: Sequence[str] = ("n", "s", "ss", "mx"),
    span: int | None = None,
    previous: bool = False,
    pairs: DataFrame | None = None,
    other: Sequence[str] = (),
) -> DataFrame:
    """Window totals ``<c>_<w>`` over [t-w, t-1] for every bucket.

    With ``previous`` the last strictly earlier time is added as ``prev_time`` from the same sorted
    pass; only where it lies outside the copied buckets is it taken from the earlier ranges' maxima.
    With ``pairs``, one row per (entity, other, time), the distinct ``other`` values in the window are added as
    ``distinct_<w>``: the pairs that the buckets count as ``c``, less the repeats of ``window_repeats``.
    """
    if not windows or any(int(w) != w or w < 1 for w in windows):
        raise ValueError("windows must be positive integers")
    entity = list(entity)
    width = max(windows)
    length = span or max(4 * width, 256)
    home = time_range(F.col(time), length)
    reach = time_range(F.col(time) + F.lit(width), length)
    columns = [*columns, "c"] if pairs is not None else list(columns)
    copied = buckets.select(*entity, time, *columns, F.explode(F.sequence(home, reach)).alias("_range"), F.col(time).alias("_own"))
    if pairs is not None:
        copied = copied.unionByName(window_repeats(pairs, entity, other, time, windows, length), allowMissingColumns=True)
    base = Window.partitionBy(*entity, "_range").orderBy(time)
    out = {}
    for w in windows:
        frame = base.rangeBetween(-w, -1)
        if pairs is not None:
            repeats = F.sum(f"_r{w}").over(base.rangeBetween(Window.unboundedPreceding, 0))
            out[f"distinct_{w}"] = (F.coalesce(F.sum("c").over(frame), F.lit(0)) - F.coalesce(repeats, F.lit(0))).cast("bigint")
        for c in columns:
            if c == "c":
                continue
            value = F.max(c).over(frame) if c == "mx" else F.sum(c).over(frame)
            out[f"{c}_{w}"] = F.coalesce(value, F.lit(0)) if c == "n" else value
    if previous:
        out["_lag"] = F.max("_own").over(base.rangeBetween(Window.unboundedPreceding, -1))
    made = copied.select(*entity, time, "_range", "_own", *[v.alias(k) for k, v in out.items()])
    made = made.where((F.col("_range") == home) & F.col("_own").isNotNull()).drop("_own")
    if not previous:
        return made.drop("_range")
    last = buckets.groupBy(*entity, home.alias("_range")).agg(F.max(time).alias("_last"))
    before = Window.partitionBy(*entity).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = last.select(*entity, "_range", F.max("_last").over(before).alias("_earlier"))
    joined = made.join(earlier, [*entity, "_range"])
    return joined.withColumn("prev_time", F.coalesce("_lag", "_earlier")).drop("_lag", "_earlier", "_range")


def previous_time(buckets: DataFrame, entity: Sequence[str], time: str, span: int = 4096) -> DataFrame:
    """Add ``prev_time``, the last strictly earlier time of the entity (null if none)."""
    ranged = buckets.withColumn("_range", time_range(F.col(time), span)).withColumn("_t", F.col(time))
    return running(ranged, entity, time, "_range", maxima=["_t"]).withColumnRenamed(
        "before__t", "prev_time"
    ).drop("_t", "_range")


def _next_sighting(seen: DataFrame, entity: Sequence[str], other: Sequence[str], time: str, span: int, reach: int) -> DataFrame:
    """Sightings (entity, other, time) with the value's next one as ``_next`` where it is at most ``reach`` later.

    Each range also gets the sightings that close behind it, so a pair with a long history is worked on range by range.
    """
    wide = max(span, reach)
    place = time_range(F.col(time), wide)
    near = F.col(time) - place * F.lit(wide) < F.lit(reach)
    seen = seen.withColumn("_back", F.explode(F.when(near, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    following = Window.partitionBy(*entity, *other, place - F.col("_back")).orderBy(time)
    return seen.withColumn("_next", F.lead(time).over(following)).where(F.col("_back") == 0).drop("_back")


def window_repeats(pairs: DataFrame, entity: Sequence[str], other: Sequence[str], time: str, windows: Sequence[int], length: int) -> DataFrame:
    """Marks (entity, _range, time, _r<w>) whose running sum in a range is the number of repeats in the window there.

    Of a value seen k times in a window k - 1 sightings repeat an earlier one: where it is seen at t and next at u < t+w,
    the window holds both for times u+1 .. t+w. Only such neighbours give marks, so values that seldom return cost
    nothing here. Both marks of a stretch go to every range it reaches into.
    """
    seen = _next_sighting(pairs.select(*entity, *other, time), entity, other, time, length, max(windows))
    t, nxt = F.col(time).cast("bigint"), F.col("_next").cast("bigint")
    stretches = [F.struct((nxt + 1).alias("start"), (t + F.lit(w)).alias("stop"), F.lit(w).alias("w")) for w in windows]
    held = seen.where(nxt - t < F.lit(max(windows))).select(*entity, F.explode(F.array(*stretches)).alias("e")).where("e.start <= e.stop")
    placed = held.select(*entity, "e.*", F.explode(F.sequence(time_range(F.col("e.start"), length), time_range(F.col("e.stop"), length))).alias("_range"))
    marks = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct((F.col("stop") + 1).alias("at"), F.lit(-1).alias("d")))
    moved = placed.select(*entity, "_range", "w", F.explode(marks).alias("m"))
    at = F.col("m.at").cast(pairs.schema[time].dataType).alias(time)
    return moved.groupBy(*entity, "_range", at).agg(*[F.sum(F.when(F.col("w") == w, F.col("m.d"))).alias(f"_r{w}") for w in windows])


def window_distinct(
    pairs: DataFrame,
    entity: Sequence[str],
    other: Sequence[str],
    time: str,
    windows: Sequence[int],
    span: int = 4096,
    unique: bool = False,
    asks: DataFrame | None = None,
) -> DataFrame:
    """Distinct ``other`` values in each window, as ``distinct_<w>`` per (entity, time).

    ``unique`` says that ``pairs`` already holds one row per (entity, other, time); ``asks`` names
    the (entity, time) points to answer, else those of ``pairs``.

    A value seen at t and next at u counts for times t+1 .. min(t+w, u). These stretches are
    disjoint per value, so the distinct count is a running sum of +1 at the start and -1 past the
    end: no growing sets.
    """
    entity, other = list(entity), list(other)
    seen = pairs.select(*entity, *other, time) if unique else pairs.select(*entity, *other, time).distinct()
    stretch = _next_sighting(seen, entity, other, time, span, max(windows))
    t, nxt = F.col(time).cast("bigint"), F.col("_next").cast("bigint")
    zero, one, minus = F.lit(0), F.lit(1), F.lit(-1)
    marks = [F.struct((t + 1).alias("at"), *[one.alias(f"d{w}") for w in windows])]
    for w in windows:
        end = F.least(t + F.lit(w), F.coalesce(nxt, t + F.lit(w))) + 1
        marks.append(F.struct(end.alias("at"), *[(minus if v == w else zero).alias(f"d{v}") for v in windows]))
    moves = stretch.select(*entity, F.explode(F.array(*marks)).alias("m")).select(
        *entity, "m.at", F.lit(0).alias("ask"), *[F.col(f"m.d{w}").alias(f"d{w}") for w in windows]
    )
    asked = asks if asks is not None else seen
    asked = asked.select(*entity, t.alias("at"), F.lit(1).alias("ask"), *[zero.alias(f"d{w}") for w in windows])
    deltas = (
        moves.unionByName(asked)
        .groupBy(*entity, "at")
        .agg(F.max("ask").alias("ask"), *[F.sum(f"d{w}").alias(f"d{w}") for w in windows])
        .withColumn("_range", time_range(F.col("at"), span))
    )
    summed = running(deltas, entity, "at", "_range", sums=[f"d{w}" for w in windows])
    return summed.where(F.col("ask") == 1).select(
        *entity,
        F.col("at").alias(time),
        *[(F.col(f"before_d{w}") + F.col(f"d{w}")).cast("bigint").alias(f"distinct_{w}") for w in windows],
    )


def past_count(df, entity, time, window, span=None):
    """Rows of the same entity in the window, for every input row."""
    return _attach(df, entity, time, range_windows(time_buckets(df, entity, time), entity, time, [window], ["n"], span)).select(
        *df.columns, F.coalesce(f"n_{window}", F.lit(0)).cast("bigint").alias(f"count_{window}")
    )


def past_mean(df, entity, time, cents, window, span=None):
    w = range_windows(time_buckets(df, entity, time, cents), entity, time, [window], ["n", "s"], span)
    mean = F.try_divide(F.col(f"s_{window}").cast("double"), F.lit(100.0) * F.col(f"n_{window}"))
    return _attach(df, entity, time, w).select(*df.columns, F.coalesce(mean, F.lit(0.0)).alias(f"mean_{window}"))


def past_max(df, entity, time, cents, window, span=None):
    w = range_windows(time_buckets(df, entity, time, cents), entity, time, [window], ["mx"], span)
    return _attach(df, entity, time, w).select(
        *df.columns, F.coalesce(F.col(f"mx_{window}") / F.lit(100.0), F.lit(0.0)).alias(f"max_{window}")
    )


def past_std(df, entity, time, cents, window, span=None):
    w = range_windows(time_buckets(df, entity, time, cents), entity, time, [window], ["n", "s", "ss"], span)
    std = std_from_moments(F.col(f"n_{window}"), F.col(f"s_{window}"), F.col(f"ss_{window}"))
    return _attach(df, entity, time, w).select(*df.columns, F.coalesce(std, F.lit(0.0)).alias(f"std_{window}"))


def past_distinct(df, entity, other, time, window, span=4096):
    known = df.where(available([*entity, *other]))
    w = window_distinct(known, entity, other, time, [window], span)
    out = df.join(w, [*entity, time], "left")
    return out.select(*df.columns, F.coalesce(f"distinct_{window}", F.lit(0)).cast("bigint").alias(f"distinct_{window}"))


def recency(df, entity, time, span=4096):
    """Time since the entity's last strictly earlier row, -1 if none."""
    prev = previous_time(time_buckets(df, entity, time), entity, time, span)
    return _attach(df, entity, time, prev).select(
        *df.columns, F.coalesce(F.col(time) - F.col("prev_time"), F.lit(-1)).cast("bigint").alias("recency")
    )


def _attach(df: DataFrame, entity: Sequence[str], time: str, summary: DataFrame) -> DataFrame:
    """Left many-to-one join of an (entity, time) summary back to its rows."""
    clash = [c for c in summary.columns if c in df.columns and c not in (*entity, time)]
    return df.join(summary.drop(*clash), [*entity, time], "left")


def _statistics(w: int) -> dict[str, Column]:
    """Mean, max and deviation of one window from its totals."""
    n, s = F.col(f"n_{w}"), F.col(f"s_{w}")
    return {
        f"mean_{w}": F.coalesce(F.try_divide(s.cast("double"), F.lit(100.0) * n), F.lit(0.0)),
        f"max_{w}": F.coalesce(F.col(f"mx_{w}") / F.lit(100.0), F.lit(0.0)),
        f"std_{w}": F.coalesce(std_from_moments(n, s, F.col(f"ss_{w}")), F.lit(0.0)),
    }


def _summarise(totals: DataFrame, keys: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """Counts and statistics per (entity, time), worked out before any row is joined to them."""
    made = {}
    for w in windows:
        made.update(_statistics(w))
    counted = [f"{c}_{w}" for c in ("n", "distinct") for w in windows if f"{c}_{w}" in totals.columns]
    return totals.select(*keys, "prev_time", *counted, *[v.alias(k) for k, v in made.items()])


def _history_table(df, entity, other, time, cents, windows, span):
    """One row per (entity, other, time) with every window total; rows are joined to it once."""
    entity, other = list(entity), list(other)
    pairs = time_buckets(df.where(available([*entity, *other])), [*entity, *other], time, cents)
    buckets = pairs.groupBy(*entity, time).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").cast(SQUARE).alias("ss"), F.max("mx").alias("mx"), F.count("*").alias("c")
    )
    totals = range_windows(buckets, entity, time, windows, span=span, previous=True, pairs=pairs, other=other)
    totals = _summarise(totals, [*entity, time], windows)
    pair_totals = range_windows(pairs.select(*entity, *other, time, F.col("n")), [*entity, *other], time, windows, ["n"], span)
    pair_totals = pair_totals.select(*entity, *other, time, *[F.col(f"n_{w}").alias(f"pair_{w}") for w in windows])
    return pair_totals.join(totals, [*entity, time])


def range_history_exact(
    df: DataFrame,
    entity: Sequence[str] = ("recipient",),
    other: Sequence[str] = ("origin",),
    time: str = "step",
    cents: str = "amount_cents",
    windows: Sequence[int] = (1, 6, 24),
    span: int | None = None,
    ratio: str = "zero",
) -> DataFrame:
    """Recipient and pair history from exact integer moments, independent of scan order.

    ``ratio`` picks the form of amount/mean: ``zero`` (0 where undefined) or ``offset``
    (mean + 1e-6 in the denominator).
    """
    table = _history_table(df, entity, other, time, cents, windows, span)
    joined = df.join(table, [*entity, *other, time], "left")
    amount = F.col(cents).cast("double") / F.lit(100.0)
    out = {
        "hour_of_day": hour_of_day(F.col(time)),
        "day_index": day_index(F.col(time)),
        "recency": F.coalesce(F.col(time) - F.col("prev_time"), F.lit(-1)).cast("int"),
    }
    zero = F.lit(0.0)
    for w in windows:
        mean = F.coalesce(f"mean_{w}", zero)
        out[f"count_{w}"] = F.coalesce(f"n_{w}", F.lit(0)).cast("bigint")
        out[f"mean_{w}"] = mean
        out[f"max_{w}"] = F.coalesce(f"max_{w}", zero)
        out[f"std_{w}"] = F.coalesce(f"std_{w}", zero)
        out[f"distinct_{w}"] = F.coalesce(f"distinct_{w}", F.lit(0)).cast("bigint")
        out[f"pair_{w}"] = F.coalesce(f"pair_{w}", F.lit(0)).cast("bigint")
        out[f"ratio_{w}"] = F.coalesce(ratio_offset(amount, mean), zero) if ratio == "offset" else ratio_or_zero(amount, mean)
    return joined.select(*df.columns, *[v.alias(k) for k, v in out.items()])


def range_history(df: DataFrame, **options) -> DataFrame:
    """History with the offset ratio form (mean + 1e-6)."""
    return range_history_exact(df, ratio="offset", **options)


def entity_history(
    df: DataFrame,
    entity: Sequence[str],
    prefix: str,
    time: str = "t",
    cents: str = "amount_cents",
    category: str | None = "category",
    epsilon: float = 1e-6,
    span: int = 4096,
) -> DataFrame:
    """Unbounded prior count, mean, deviation, ratio, recency and distinct categories per entity.

    A row whose entity misses a component gets nulls and zero flags; an entity without history
    gets count 0 and null moments.
    """
    entity = list(entity)
    buckets = time_buckets(df, entity, time, cents).drop("mx")
    if category:
        fresh = first_seen(df, entity, category, time)
        buckets = buckets.join(fresh, [*entity, time], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    sums = ["n", "s", "ss"] + (["fresh"] if category else [])
    ranged = buckets.withColumn("_range", time_range(F.col(time), span)).withColumn("_t", F.col(time))
    prior = running(ranged, entity, time, "_range", sums=sums, maxima=["_t"])
    n, s = F.col("before_n"), F.col("before_s")
    summary = prior.select(
        *entity,
        time,
        n.cast("bigint").alias(f"{prefix}_count"),
        F.try_divide(s.cast("double"), F.lit(100.0) * n).alias(f"{prefix}_mean"),
        std_from_moments(n, s, F.col("before_ss").cast(SQUARE)).alias(f"{prefix}_std"),
        (F.col(time) - F.col("before__t")).alias(f"{prefix}_recency"),
        *([F.col("before_fresh").cast("bigint").alias(f"{prefix}_distinct")] if category else []),
    )
    joined = df.join(summary, [*entity, time], "left")
    mean = F.col(f"{prefix}_mean")
    return joined.withColumns(
        {f"{prefix}_ratio": ratio_offset(F.col(cents) / F.lit(100.0), mean, epsilon), **history_flags(entity, prefix)}
    ).select(
        *df.columns,
        f"{prefix}_available",
        *[f"{prefix}_{c}" for c in ("count", "mean", "std", "ratio", "recency")],
        *([f"{prefix}_distinct"] if category else []),
        f"{prefix}_has_history",
        f"{prefix}_has_std",
    )


def history_flags(entity: Sequence[str], prefix: str) -> dict[str, Column]:
    count = F.coalesce(F.col(f"{prefix}_count"), F.lit(0))
    return {
        f"{prefix}_available": available(entity).cast("int"),
        f"{prefix}_has_history": (count >= 1).cast("int"),
        f"{prefix}_has_std": (count >= 2).cast("int"),
    }


def first_seen(df: DataFrame, entity: Sequence[str], category: str, time: str) -> DataFrame:
    """Number of categories an entity shows for the first time, per (entity, time)."""
    known = df.where(available([*entity, category]))
    return (
        known.groupBy(*entity, category)
        .agg(F.min(time).alias(time))
        .groupBy(*entity, time)
        .agg(F.count("*").alias("fresh"))
    )


def prior_distinct(df, entity, category, time, span=4096):
    """Distinct categories of the entity seen strictly earlier."""
    entity = list(entity)
    buckets = time_buckets(df, entity, time).join(first_seen(df, entity, category, time), [*entity, time], "left")
    ranged = buckets.withColumn("fresh", F.coalesce("fresh", F.lit(0))).withColumn("_range", time_range(F.col(time), span))
    prior = running(ranged, entity, time, "_range", sums=["fresh"])
    return df.join(prior.select(*entity, time, F.col("before_fresh").cast("bigint").alias("prior_distinct")), [*entity, time], "left")


def build_entity_features(df: DataFrame, granularities: dict[str, Sequence[str]], **options) -> DataFrame:
    """``entity_history`` for several entity definitions; the label, if carried, is not read."""
    out = df
    for prefix, columns in granularities.items():
        out = entity_history(out, columns, prefix, **options)
    return out


def merchant_history(
    df: DataFrame,
    merchant: str = "merchant",
    customer: str | None = "customer",
    time: str = "step",
    cents: str = "amount_cents",
    windows: Sequence[int] = (1, 7, 30),
    mode: str = "HL",
    limit: int = 7,
    span: int | None = None,
) -> DataFrame:
    """Merchant history in one of three modes.

    ``H0`` none, ``HS`` every window and the recency cut to ``limit`` steps, ``HL`` full.
    Without ``customer`` there are no distinct customers; a row without one counts, but not as a customer. Rows are shuffled
    once, to the (merchant, time range) groups where all is worked out; ``HL`` shuffles one line a group more, for the recency.
    """
    if mode not in ("H0", "HS", "HL"):
        raise ValueError("mode must be H0, HS or HL")
    if mode == "H0":
        return df
    if not windows or any(int(w) != w or w < 1 for w in windows):
        raise ValueError("windows must be positive integers")
    reach = {w: min(w, limit) if mode == "HS" else w for w in windows}
    used = sorted(set(reach.values()))
    length = span or max(4 * used[-1], 256)
    others = [c for c in df.columns if c not in (merchant, customer, time, cents)]
    seen = [customer] if customer is not None else []
    rows = gathered(df, merchant, time, used[-1], length, [cents, *seen], others)
    told = _row_windows(rows, [merchant, "_range"], customer, time, cents, used)
    gap = F.col(time) - F.col("_lag")
    if mode == "HS":
        gap = F.when(gap <= limit, gap)
    else:
        told = told.join(_last_before(rows, merchant, time), [merchant, "_range"], "left")
        gap = F.coalesce(gap, F.col(time) - F.col("_earlier"))
    made = {"_gap": gap}
    for w in used:
        made.update({f"n_{w}": F.col(f"n_{w}"), **_statistics(w)} | ({f"distinct_{w}": F.col(f"distinct_{w}")} if seen else {}))
    joined = told.select(*df.columns, *[v.alias(k) for k, v in made.items()])
    amount = F.col(cents) / F.lit(100.0)
    out = {}
    zero = F.lit(0.0)
    for w, r in reach.items():
        mean = F.coalesce(f"mean_{r}", zero)
        out[f"h{w}_count"] = F.coalesce(f"n_{r}", F.lit(0)).cast("bigint")
        if customer is not None:
            out[f"h{w}_customers"] = F.coalesce(f"distinct_{r}", F.lit(0)).cast("bigint")
        out[f"h{w}_mean"] = mean
        out[f"h{w}_max"] = F.coalesce(f"max_{r}", zero)
        out[f"h{w}_std"] = F.coalesce(f"std_{r}", zero)
        out[f"h{w}_ratio"] = ratio_or_zero(amount, mean)
    out["recency"] = F.coalesce("_gap", F.lit(-1)).cast("int")
    out["recency_available"] = F.col("_gap").isNotNull().cast("int")
    return joined.select(*df.columns, *[v.alias(k) for k, v in out.items()])


def gathered(df: DataFrame, entity: str, time: str, width: int, length: int, columns: Sequence[str], others: Sequence[str] = ()) -> DataFrame:
    """The rows in (entity, _range) groups, shuffled once and only here: what follows works inside the groups.

    A group holds the rows of a range of ``length`` times (``_own``) and copies of the earlier ones that a window of
    ``width`` reaches; ``others`` are null in copies. A row without a time has a null range. The number of parts is given:
    adaptive execution would merge them by their few bytes, and the sorts and sums that follow would spill.
    """
    home, last = time_range(F.col(time), length), time_range(F.col(time) + F.lit(width), length)
    placed = df.select(entity, time, *columns, *others, F.explode_outer(F.sequence(home, last)).alias("_range"), home.alias("_home"))
    own = F.col("_range").eqNullSafe(F.col("_home"))
    placed = placed.select(entity, "_range", time, *columns, *[F.when(own, F.col(c)).alias(c) for c in others], own.alias("_own"))
    return placed.repartition(default_ranges(df), entity, "_range")


def _row_windows(rows, keys, other, time, cents, windows, sums=None, xors=None):
    """The own rows of ``gathered`` groups, or of finer ones by ``keys``, with the totals of their windows; ``_lag`` is the step before in the group.

    Sums of a window are differences of two running sums, exact in integers, so a row is added once a window however many
    rows the window holds. With ``other``, ``distinct_<w>`` counts the last row of each value and step, less the repeats:
    marks as in ``window_repeats``, put beside the rows, since all neighbours of a value that a window can hold lie in its group.
    ``sums`` and ``xors`` name further values that are added up, or combined by xor, over the windows.
    """
    kind, base = rows.schema[time].dataType, available([keys[0], time])
    own = F.col("_own")
    rows = rows.withColumn("_at", F.col(time))
    if other is not None:
        rows = rows.withColumn("_next", F.lead(time).over(Window.partitionBy(*keys, other).orderBy(time)))
        gap = F.col("_next") - F.col(time)
        ends = [(a, w, d) for w in windows if w > 1 for a, d in ((F.col("_next") + 1, 1), (F.col(time) + F.lit(w + 1), -1))]
        entry = lambda a, w, d: F.struct(a.cast(kind).alias("at"), F.lit(w).alias("w"), F.lit(d).alias("d"))
        entries = F.array(entry(F.col(time), 0, 0))
        if ends:
            returns = base & F.col(other).isNotNull() & (gap > 0) & (gap < F.lit(max(windows)))
            marks = F.filter(F.array(*[entry(*e) for e in ends]), lambda m: gap < m["w"])
            entries = F.when(returns, F.concat(entries, marks)).otherwise(entries)
        rows = rows.withColumn("_e", F.explode(entries)).withColumn("_at", F.col("_e.at"))
        own = own & (F.col("_e.w") == 0)
        base = base & (F.col("_e.w") == 0)
    wide = F.col(cents).cast("decimal(19,0)")
    sums = {"n": F.lit(1), "s": F.col(cents), "ss": (wide * wide).cast(SQUARE), **(sums or {})}
    xors = xors or {}
    if other is not None:
        sums["c"] = F.when(F.col(other).isNotNull() & ~F.coalesce(gap == 0, F.lit(False)), F.lit(1))
    values = {f"_{k}": F.when(base, v) for k, v in (sums | xors | {"seen": F.col(time)}).items()}
    if other is not None:
        values |= {f"_r{w}": F.when(F.col("_e.w") == w, F.col("_e.d")) for w in windows}
    order = Window.partitionBy(*keys).orderBy("_at")
    until = lambda back: order.rangeBetween(Window.unboundedPreceding, -back)
    out = {"_lag": F.max("_seen").over(until(1))}
    for back in (1, *[w + 1 for w in windows]):
        out |= {f"_{k}_{back}": F.coalesce(F.sum(f"_{k}").over(until(back)), F.lit(0)) for k in sums}
        out |= {f"_{k}_{back}": F.coalesce(F.bit_xor(f"_{k}").over(until(back)), F.lit(0)) for k in xors}
    for w in windows:
        out[f"mx_{w}"] = F.max("_s").over(order.rangeBetween(-w, -1))
        if other is not None:
            out[f"_r{w}"] = F.coalesce(F.sum(f"_r{w}").over(until(0)), F.lit(0))
    kept = [c for c in rows.columns if c not in ("_next", "_e", "_at", "_own")]
    run = rows.select(*kept, "_at", own.alias("_own"), *[v.alias(k) for k, v in values.items()])
    run = run.select(*kept, "_own", *[v.alias(k) for k, v in out.items()]).where("_own")
    inside = lambda k, w: F.col(f"_{k}_1") - F.col(f"_{k}_{w + 1}")
    made = {}
    for w in windows:
        made |= {f"{k}_{w}": inside(k, w) for k in sums if k != "c"}
        made |= {f"ss_{w}": inside("ss", w).cast(SQUARE), f"mx_{w}": F.col(f"mx_{w}")}
        made |= {f"{k}_{w}": F.col(f"_{k}_1").bitwiseXOR(F.col(f"_{k}_{w + 1}")) for k in xors}
        if other is not None:
            made[f"distinct_{w}"] = inside("c", w) - F.col(f"_r{w}")
    return run.select(*kept, "_lag", *[v.alias(k) for k, v in made.items()])


def _last_before(rows, entity, time):
    """(entity, _range, _earlier): the last time of the entity's earlier ranges.

    The hash names every column and the entity is a maximum, so that neither fewer columns nor fewer rows are asked of
    ``rows`` than elsewhere and Spark reads its one shuffle again instead of making a second one.
    """
    ends = rows.groupBy(entity, "_range").agg(
        F.max(entity).alias("_entity"), F.max(F.when(F.col("_own"), F.col(time))).alias("_last"), F.bit_xor(F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind])).alias("_whole")
    )
    before = Window.partitionBy("_entity").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return ends.where(F.col("_whole").isNotNull()).select(F.col("_entity").alias(entity), "_range", F.max("_last").over(before).alias("_earlier"))


def history_builds(
    df: DataFrame,
    spans: Sequence[int | None] = (None, 50),
    used: Column | None = None,
    merchant: str = "merchant",
    time: str = "step",
    cents: str = "amount_cents",
    identity: str = "id",
    window: int = 7,
) -> DataFrame:
    """Two builds of the history of ``merchant_history``, cut by either span, side by side: one line a (merchant, step).

    ``a_`` and ``b_`` are the builds: ``rows``, whether all features are ``known``, the ends ``lo_`` and ``hi_`` of ``count``,
    ``mean`` and ``std`` over the step's rows, and the ids that the window held, as ``used``, ``id_sum`` and ``id_xor`` of
    ``history_sets``; the second build takes these from the rows where ``used`` holds. A build that has no row of a step
    leaves nulls. Every row goes to both builds, each with windows in its own ranges. The spans divide the range that rows
    are gathered by, so both builds, and the lines that compare them, come from one shuffle of the rows.
    """
    lengths = [s or max(4 * window, 256) for s in spans]
    drawn = F.coalesce(used, F.lit(False)) if used is not None else F.lit(True)
    source = df.where(available([merchant, time])).select(merchant, time, cents, F.xxhash64(identity).alias("_id"), drawn.alias("_used"))
    rows = gathered(source, merchant, time, window, math.lcm(*lengths), [cents, "_id", "_used"])
    at = F.col(time)

    def cuts(build, length):
        reached = F.sequence(time_range(at, length), time_range(at + F.lit(window), length))
        return F.transform(reached, lambda r: F.struct(F.lit(build).alias("build"), r.alias("cut")))

    home = F.when(F.col("_c.build") == 0, time_range(at, lengths[0])).otherwise(time_range(at, lengths[1]))
    cut = rows.withColumn("_c", F.explode(F.concat(*[cuts(b, n) for b, n in enumerate(lengths)]))).select(
        merchant, "_range", time, cents, "_id", (F.col("_used") | (F.col("_c.build") == 0)).alias("_used"),
        F.col("_c.build").alias("_build"), F.col("_c.cut").alias("_cut"), (F.col("_own") & (F.col("_c.cut") == home)).alias("_own"),
    )
    sums = {"u": F.when(F.col("_used"), F.lit(1)), "us": F.when(F.col("_used"), F.col("_id").cast("decimal(38,0)"))}
    told = _row_windows(cut, [merchant, "_range", "_build", "_cut"], None, time, cents, [window], sums, {"ux": F.when(F.col("_used"), F.col("_id"))})
    features = {"count": F.col(f"n_{window}").cast("double"), "mean": F.col(f"mean_{window}"), "std": F.col(f"std_{window}")}
    stated = told.withColumns(_statistics(window)).select(
        merchant, "_range", time, "_build", *[v.alias(k) for k, v in features.items()], *[f"{k}_{window}" for k in ("u", "us", "ux")]
    )
    out = []
    for b, side in enumerate("ab"):
        of = lambda v, b=b: F.when(F.col("_build") == b, v)
        known = F.col("count").isNotNull() & F.col("mean").isNotNull() & F.col("std").isNotNull()
        out += [F.count(of(F.lit(1))).alias(f"{side}_rows"), F.bool_and(of(known)).alias(f"{side}_known")]
        out += [end(of(F.col(c))).alias(f"{side}_{name}_{c}") for c in features for end, name in ((F.min, "lo"), (F.max, "hi"))]
        out += [F.max(of(F.col(f"{k}_{window}"))).alias(f"{side}_{name}") for k, name in (("u", "used"), ("us", "id_sum"), ("ux", "id_xor"))]
    return stated.groupBy(merchant, "_range", time).agg(*out).drop("_range")


def history_provenance(
    df: DataFrame, entity: str = "merchant", time: str = "step", identity: str = "id", window: int = 7, asked: DataFrame | None = None
) -> DataFrame:
    """Long table of the earlier row ids each row's window used: (id, used_id, used_time), of the ids in ``asked`` if given.

    Every (row, used row) combination is the output itself, so it is a listing for the ids in question;
    whole tables are checked by ``history_sets``. Times are cut into ranges of the window width, so a row
    meets only its own range and the one before.
    """
    wanted = df if asked is None else df.join(asked.select(identity).distinct(), identity, "left_semi")
    left = wanted.select(F.col(identity), F.col(entity), F.col(time)).withColumn(
        "_range", F.explode(F.array(time_range(F.col(time), window), time_range(F.col(time), window) - 1))
    )
    right = df.select(
        F.col(identity).alias("used_id"), F.col(entity), F.col(time).alias("used_time"),
        time_range(F.col(time), window).alias("_range"),
    )
    met = left.join(right, [entity, "_range"])
    gap = F.col(time) - F.col("used_time")
    return met.where((gap >= 1) & (gap <= window)).select(identity, entity, time, "used_id", "used_time")


def history_sets(
    df: DataFrame, entity: str = "merchant", time: str = "step", identity: str = "id", window: int = 7, used: DataFrame | None = None, span: int | None = None
) -> DataFrame:
    """(entity, time, rows, used, id_sum, id_xor): which ids the window before each time holds, without listing them.

    A set of ids is told by its size and by the sum and the xor of the ids' hashes, which add up over the
    steps of a window; one row a step is all that is windowed. ``used`` are the rows that the window
    draws on, those of ``df`` if not given. The rows of a step share its history.
    """
    h = F.xxhash64(identity)
    source = (used if used is not None else df).groupBy(entity, time).agg(
        F.count("*").alias("_n"), F.sum(h.cast("decimal(38,0)")).alias("_s"), F.bit_xor(h).alias("_x")
    )
    steps = df.groupBy(entity, time).agg(F.count("*").alias("rows")).join(source, [entity, time], "full")
    length = span or max(4 * window, 256)
    copied = steps.withColumn("_home", time_range(F.col(time), length)).withColumn(
        "_range", F.explode(F.sequence("_home", time_range(F.col(time) + F.lit(window), length)))
    )
    frame = Window.partitionBy(entity, "_range").orderBy(time).rangeBetween(-window, -1)
    sums = {"used": F.coalesce(F.sum("_n").over(frame), F.lit(0)), "id_sum": F.sum("_s").over(frame), "id_xor": F.bit_xor("_x").over(frame)}
    seen = copied.withColumns(sums).where((F.col("_range") == F.col("_home")) & F.col("rows").isNotNull())
    return seen.select(entity, time, "rows", *sums)


def listed_sets(provenance: DataFrame, identity: str = "id", used: str = "used_id") -> DataFrame:
    """(id, used, id_sum, id_xor) of a listing, to hold against ``history_sets``."""
    h = F.xxhash64(used)
    return provenance.groupBy(identity).agg(F.count("*").alias("used"), F.sum(h.cast("decimal(38,0)")).alias("id_sum"), F.bit_xor(h).alias("id_xor"))


def provenance_summary(df, entity="merchant", time="step", identity="id", window=7, span=None):
    """Number of used rows and exact id bounds per row, without listing them."""
    buckets = df.groupBy(entity, time).agg(
        F.count("*").alias("n"), F.min(identity).alias("lo"), F.max(identity).alias("hi")
    )
    length = span or max(4 * window, 256)
    copied = buckets.withColumn("_home", time_range(F.col(time), length)).withColumn(
        "_range", F.explode(F.sequence("_home", time_range(F.col(time) + F.lit(window), length)))
    )
    frame = Window.partitionBy(entity, "_range").orderBy(time).rangeBetween(-window, -1)
    seen = copied.withColumns(
        {
            "used": F.coalesce(F.sum("n").over(frame), F.lit(0)),
            "first_used": F.min("lo").over(frame),
            "last_used": F.max("hi").over(frame),
        }
    ).where(F.col("_range") == F.col("_home"))
    return df.select(identity, entity, time).join(seen.select(entity, time, "used", "first_used", "last_used"), [entity, time], "left")
