"""Moving time-block bootstrap on whole populations.

A replicate is a multiplicity per distinct time. Rows are never copied: (time, score) counts are
joined to the multiplicities and summed. Draws come from hashed counters, so any executor, retry or
engine yields the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.prefix import running, settle, value_edges, with_range
from riskframe.functions.scalars import hash_draw, review_slots, safe_divide
from riskframe.operators.splits import time_grid


def time_positions(df: DataFrame, keys: Sequence[str] = ("fold",), time: str = "time") -> DataFrame:
    """Distinct times per key with their position 0..T-1 and the group count T."""
    grid = time_grid(df.select(*keys, time), time, keys=keys)
    return grid.select(*keys, time, (F.col("position") - 1).cast("int").alias("pos"), F.col("groups").cast("int").alias("groups"))


def default_block(groups: Column) -> Column:
    """max(2, round(T^(1/3)))."""
    return F.greatest(F.lit(2), F.bround(F.pow(groups.cast("double"), F.lit(1.0 / 3.0))).cast("int"))


def moving_blocks(
    positions: DataFrame, keys: Sequence[str], replicates: int, seed: int, lengths: Sequence[int | str] = ("default",)
) -> DataFrame:
    """Overlapping, non-circular blocks cut to T draws: (keys, block_length, replicate_id, draw, pos).

    A length is a number of groups, or ``default``, ``half`` (rounded up) or ``double`` of it.
    """
    keys = list(keys)
    base = default_block(F.col("groups"))
    named = {"default": base, "half": F.ceil(base / F.lit(2)).cast("int"), "double": base * 2}
    options = [named[n] if isinstance(n, str) else F.lit(int(n)) for n in lengths]
    heads = positions.select(*keys, "groups").distinct()
    heads = heads.withColumn("block_length", F.explode(F.array_distinct(F.array(*options))))
    heads = heads.where((F.col("block_length") >= 1) & (F.col("block_length") <= F.col("groups")))
    reps = heads.withColumn("replicate_id", F.explode(F.sequence(F.lit(1), F.lit(int(replicates)))))
    reps = reps.repartition(*keys, "block_length", "replicate_id")
    last = F.ceil(F.col("groups") / F.col("block_length")).cast("int") - 1
    blocks = reps.withColumn("_block", F.explode(F.sequence(F.lit(0), last)))
    legal = F.col("groups") - F.col("block_length") + 1
    start = hash_draw(str(seed), *[F.col(k) for k in keys], F.col("block_length"), F.col("replicate_id"), F.col("_block"))
    spread = blocks.withColumn("_start", (start % legal).cast("int")).withColumn(
        "_o", F.explode(F.sequence(F.lit(0), F.col("block_length") - 1))
    )
    draw = F.col("_block") * F.col("block_length") + F.col("_o")
    return spread.where(draw < F.col("groups")).select(
        *keys, "block_length", "replicate_id", draw.alias("draw"), (F.col("_start") + F.col("_o")).alias("pos")
    )


def multiplicities(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Draws per time group; times that were not drawn are absent."""
    return draws.groupBy(*keys, "block_length", "replicate_id", "pos").agg(F.count("*").cast("int").alias("mult"))


def draw_fingerprint(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SHA-256 of each drawn sequence (T numbers per replicate)."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("draw", "pos"))), lambda d: d["pos"].cast("string"))
    return draws.groupBy(*keys, "block_length", "replicate_id").agg(
        F.sha2(F.array_join(ordered, ","), 256).alias("fingerprint"), F.count("*").alias("drawn")
    )


def with_position(df: DataFrame, positions: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    return df.join(settle(positions.drop("groups")), [*keys, time])


def population(df: DataFrame, mult: DataFrame, draw_keys: Sequence[str], keys: Sequence[str], label: str) -> DataFrame:
    """Rows and positives of every replicate."""
    cells = df.groupBy(*keys, "pos").agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_p"))
    return cells.join(mult, [*draw_keys, "pos"]).groupBy(*keys, "block_length", "replicate_id").agg(
        F.sum(F.col("_n") * F.col("mult")).alias("n"), F.sum(F.col("_p") * F.col("mult")).alias("positives")
    )


def weighted_threshold_metrics(
    df: DataFrame, mult: DataFrame, draw_keys: Sequence[str], keys: Sequence[str], label: str, decision: str, fn_cost=100.0, fp_cost=1.0
) -> DataFrame:
    """TP, FP, FN, cost, recall and saving rate of fixed decisions, per replicate."""
    y, a = F.col(label), F.col(decision)
    cells = df.groupBy(*keys, "pos").agg(
        F.count("*").alias("_n"),
        F.sum(y.cast("bigint")).alias("_p"),
        F.sum((y * a).cast("bigint")).alias("_tp"),
        F.sum(((1 - y) * a).cast("bigint")).alias("_fp"),
    )
    w = F.col("mult")
    sums = cells.join(mult, [*draw_keys, "pos"]).groupBy(*keys, "block_length", "replicate_id").agg(
        F.sum(w * F.col("_n")).alias("n"), F.sum(w * F.col("_p")).alias("positives"),
        F.sum(w * F.col("_tp")).alias("tp"), F.sum(w * F.col("_fp")).alias("fp"),
    )
    fn = F.col("positives") - F.col("tp")
    cost = F.lit(float(fn_cost)) * fn + F.lit(float(fp_cost)) * F.col("fp")
    normal = F.lit(float(fn_cost)) * F.col("positives")
    return sums.withColumns({"fn": fn, "cost": cost}).withColumns(
        {
            "recall": safe_divide(F.col("tp"), F.col("positives")),
            "cost_saving_rate": safe_divide(normal - F.col("cost"), normal),
        }
    )


def _weighted_curve_ap(summed: DataFrame, keys: Sequence[str], level: str, edges) -> DataFrame:
    """AP per key from (key, level) sums n, p."""
    ranged = with_range(summed, level, edges, "_range")
    curve = running(ranged, keys, level, "_range", sums=["n", "p"], descending=True, totals=True)
    tp, alerts = F.col("before_p") + F.col("p"), F.col("before_n") + F.col("n")
    gain = safe_divide(F.col("p"), F.col("total_p")) * safe_divide(tp, alerts)
    return curve.groupBy(*keys).agg(F.sum(gain).alias("ap"))


def weighted_ap(df: DataFrame, mult: DataFrame, draw_keys: Sequence[str], keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Exact AP of every replicate over all score levels."""
    edges = value_edges(df, score)
    summed = _summed(df, mult, draw_keys, keys, score, label)
    return _weighted_curve_ap(summed, [*keys, "block_length", "replicate_id"], score, edges)


def _cells(df: DataFrame, keys: Sequence[str], level: str, label: str, extra: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, "pos", *extra, level).agg(
        F.count("*").alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_p")
    )


def _summed(df, mult, draw_keys, keys, level, label):
    w = F.col("mult")
    return _cells(df, keys, level, label).join(mult, [*draw_keys, "pos"]).groupBy(
        *keys, "block_length", "replicate_id", level
    ).agg(F.sum(F.col("_n") * w).alias("n"), F.sum(F.col("_p") * w).alias("p"))


def positive_levels(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Map every score level to the highest level at or below it that holds a positive."""
    keys = list(keys)
    levels = df.groupBy(*keys, score).agg(F.max(F.when(F.col(label) == 1, F.col(score))).alias("_own"))
    ranged = with_range(levels, score, value_edges(df, score), "_range")
    placed = running(ranged, keys, score, "_range", maxima=["_own"])
    return placed.select(*keys, score, F.greatest("_own", "before__own").alias("_level")).where(F.col("_level").isNotNull())


def positive_level_ap(df: DataFrame, mult: DataFrame, draw_keys: Sequence[str], keys: Sequence[str], score: str, label: str) -> DataFrame:
    """The same AP from score levels with positives only: what lies between them is merged first.

    Replicates without positives get a null AP; they are kept.
    """
    keys = list(keys)
    merged = df.join(positive_levels(df, keys, score, label), [*keys, score])
    summed = _summed(merged, mult, draw_keys, keys, "_level", label)
    every = [*keys, "block_length", "replicate_id"]
    found = _weighted_curve_ap(summed, every, "_level", value_edges(df.where(F.col(label) == 1), score))
    whole = population(df, mult, draw_keys, keys, label).select(*every)
    return whole.join(found, every, "left")


def weighted_topk_tp(
    df: DataFrame, mult: DataFrame, draw_keys: Sequence[str], keys: Sequence[str], score: str, label: str, identity: str, q: float = 0.03
) -> DataFrame:
    """True positives when each replicate re-applies its own review budget ceil(q n).

    Three steps keep the work small and exact: score ranges find where each budget ends, then only
    the levels of that range are expanded, then only the rows tied at the boundary level, by id.
    """
    keys = list(keys)
    every = [*keys, "block_length", "replicate_id"]
    ranged = with_range(df, score, value_edges(df, score), "_range")
    cells = _cells(ranged, keys, score, label, ["_range"])
    w = F.col("mult")
    add = [F.sum(F.col("_n") * w).alias("n"), F.sum(F.col("_p") * w).alias("p")]
    coarse_cells = cells.groupBy(*keys, "pos", "_range").agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
    coarse = coarse_cells.join(mult, [*draw_keys, "pos"]).groupBy(*every, "_range").agg(*add)
    down = Window.partitionBy(*every).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*every)
    budget = coarse.select(
        *every, "_range", "n",
        F.coalesce(F.sum("n").over(down), F.lit(0)).alias("_bn"),
        F.coalesce(F.sum("p").over(down), F.lit(0)).alias("_bp"),
        F.sum("n").over(whole).alias("rows"),
        F.sum("p").over(whole).alias("positives"),
    ).withColumn("alerts", review_slots(F.col("rows"), q))
    at = budget.where((F.col("_bn") < F.col("alerts")) & (F.col("alerts") <= F.col("_bn") + F.col("n"))).drop("n")
    fine = (
        cells.join(at, [*keys, "_range"])
        .join(mult, [*draw_keys, "block_length", "replicate_id", "pos"])
        .groupBy(*every, "_range", "rows", "positives", "alerts", "_bn", "_bp", score)
        .agg(*add)
    )
    inside = Window.partitionBy(*every).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    level = fine.withColumns(
        {
            "_bn": F.col("_bn") + F.coalesce(F.sum("n").over(inside), F.lit(0)),
            "_bp": F.col("_bp") + F.coalesce(F.sum("p").over(inside), F.lit(0)),
        }
    ).where((F.col("_bn") < F.col("alerts")) & (F.col("alerts") <= F.col("_bn") + F.col("n")))
    level = level.withColumn("_room", F.col("alerts") - F.col("_bn"))
    split = level.where(F.col("_room") < F.col("n")).select(*every, score, "_room")
    members = (
        df.select(*keys, "pos", score, label, identity)
        .join(split, [*keys, score])
        .join(mult, [*draw_keys, "block_length", "replicate_id", "pos"])
    )
    tied = with_range(members, identity, value_edges(df, identity), "_id_range")
    spread = running(tied, every, identity, "_id_range", sums=["mult"])
    taken = F.greatest(F.lit(0), F.least(F.col("mult"), F.col("_room") - F.col("before_mult")))
    partial = spread.groupBy(*every).agg(F.sum(taken * F.col(label)).alias("_part"))
    return level.join(partial, every, "left").select(
        *every, F.col("rows").alias("n"), "positives", "alerts",
        (F.col("_bp") + F.when(F.col("_room") == F.col("n"), F.col("p")).otherwise(F.coalesce("_part", F.lit(0)))).cast("bigint").alias("tp"),
    )


def replicate_table(df, mult, draw_keys, keys, score, label, identity, q: float = 0.03) -> DataFrame:
    """n, positives, alerts, tp and ap of every replicate and model key."""
    every = [*keys, "block_length", "replicate_id"]
    top = weighted_topk_tp(df, mult, draw_keys, keys, score, label, identity, q)
    return top.join(positive_level_ap(df, mult, draw_keys, keys, score, label), every)


def occurrence_rows(df: DataFrame, mult: DataFrame, draw_keys: Sequence[str]) -> DataFrame:
    """The duplicated population itself, with an occurrence number; used to check the kernels."""
    return df.join(mult, [*draw_keys, "pos"]).withColumn("occurrence", F.explode(F.sequence(F.lit(1), F.col("mult")))).drop("mult")


# ---- paired effects over replicates ------------------------------------------------------------


def paired_components(
    table: DataFrame, keys: Sequence[str], contrasts: Sequence[tuple[str, str, str]], model: str = "model", cost: float = 101.0
) -> DataFrame:
    """Candidate minus baseline on identical draws; ``paired_ok`` is 0 where the populations differ."""
    keys = list(keys)
    side = lambda role: table.select(*keys, F.col(model).alias(role), *[F.col(c).alias(f"_{role}_{c}") for c in ("n", "positives", "alerts", "tp", "ap")])
    listed = F.array(*[F.struct(F.lit(c).alias("contrast"), F.lit(a).alias("baseline"), F.lit(b).alias("candidate")) for c, a, b in contrasts])
    base = side("baseline").withColumn("_c", F.explode(listed)).where(F.col("_c.baseline") == F.col("baseline"))
    base = base.select("*", F.col("_c.contrast").alias("contrast"), F.col("_c.candidate").alias("candidate")).drop("_c")
    both = base.join(side("candidate"), [*keys, "candidate"])
    b, c = (lambda m: F.col(f"_baseline_{m}")), (lambda m: F.col(f"_candidate_{m}"))
    same = (b("n") == c("n")) & (b("positives") == c("positives")) & (b("alerts") == c("alerts"))
    gain = c("tp") - b("tp")
    return both.select(
        *keys, "contrast", "baseline", "candidate",
        b("n").alias("n"), b("positives").alias("positives"), b("alerts").alias("alerts"),
        same.cast("int").alias("paired_ok"),
        (c("ap") - b("ap")).alias("delta_ap"),
        gain.alias("delta_tp"),
        safe_divide(gain, b("positives")).alias("delta_recall"),
        (F.lit(cost) * gain).alias("cost_reduction"),
    )


def transferred(table: DataFrame, keys: Sequence[str], baseline: str, candidate: str, model: str = "model") -> DataFrame:
    """Effects of decisions at thresholds carried over from validation."""
    keys = list(keys)
    fields = ("n", "positives", "tp", "fp", "cost")
    a = table.where(F.col(model) == baseline).select(*keys, *[F.col(c).alias(f"_a_{c}") for c in fields])
    b = table.where(F.col(model) == candidate).select(*keys, *[F.col(c).alias(f"_b_{c}") for c in fields])
    x, y = (lambda m: F.col(f"_a_{m}")), (lambda m: F.col(f"_b_{m}"))
    return a.join(b, keys).select(
        *keys,
        ((x("n") == y("n")) & (x("positives") == y("positives"))).cast("int").alias("paired_ok"),
        safe_divide(y("tp") - x("tp"), x("positives")).alias("delta_recall"),
        (x("cost") - y("cost")).alias("cost_reduction"),
        safe_divide(y("tp") + y("fp") - x("tp") - x("fp"), x("n")).alias("delta_alert_rate"),
    )


def complete_mean(df: DataFrame, keys: Sequence[str], over: str, expected: int, metrics: Sequence[str]) -> DataFrame:
    """Mean over seeds or folds; a missing or undefined member makes the mean null."""
    full = F.countDistinct(over) == expected
    return df.groupBy(*keys).agg(
        *[F.when(full & (F.count(m) == F.count("*")), F.avg(m)).alias(m) for m in metrics]
    )


def seed_mean(df: DataFrame, keys: Sequence[str], expected: int, cost: float = 101.0) -> DataFrame:
    """Mean AP and TP effects over seeds; recall and cost follow from the mean TP effect."""
    keys = list(keys)
    out = complete_mean(df.withColumn("_p", F.col("positives").cast("double")), keys, "seed", expected, ["delta_ap", "delta_tp", "_p"])
    return out.select(
        *keys, "delta_ap", "delta_tp",
        safe_divide(F.col("delta_tp"), F.col("_p")).alias("delta_recall"),
        (F.lit(cost) * F.col("delta_tp")).alias("cost_reduction"),
    )


def fold_equal_mean(df, keys, expected, metrics):
    return complete_mean(df, keys, "fold", expected, metrics)


def melt(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", "value")


def interval_summary(
    long: DataFrame, keys: Sequence[str], confidence: float = 0.95, min_valid: int = 0, value: str = "value"
) -> DataFrame:
    """Percentile interval with its validity accounting, per key (one value per replicate).

    A group holds one number per replicate, so the exact ``percentile`` is bounded.
    """
    alpha = (1 - confidence) / 2
    v = F.col(value)
    out = long.groupBy(*keys).agg(
        F.avg(v).alias("mean"),
        F.percentile(v, F.lit(0.5)).alias("median"),
        F.stddev_samp(v).alias("se"),
        F.percentile(v, F.lit(alpha)).alias("lower"),
        F.percentile(v, F.lit(1 - alpha)).alias("upper"),
        F.avg((v > 0).cast("double")).alias("share_positive"),
        F.avg((v < 0).cast("double")).alias("share_negative"),
        F.avg((v == 0).cast("double")).alias("share_zero"),
        F.count("*").alias("draws"),
        F.count(v).alias("valid"),
    )
    enough = (F.col("valid") >= max(min_valid, 1))
    crosses = F.coalesce((F.col("lower") <= 0) & (F.col("upper") >= 0), F.lit(True))
    return out.withColumns(
        {
            "invalid": F.col("draws") - F.col("valid"),
            "invalid_rate": (F.col("draws") - F.col("valid")) / F.col("draws"),
            "lower": F.when(enough, F.col("lower")),
            "upper": F.when(enough, F.col("upper")),
            "status": F.when(enough, "reported").otherwise("insufficient_valid_draws"),
            "crosses_zero": crosses.cast("int"),
        }
    )


def factorial_summary(
    df: DataFrame, keys: Sequence[str], seeds: int, metric: str, cells: Sequence[str] = ("B0", "B0H", "B1", "B1H"), cell: str = "cell"
) -> DataFrame:
    """Seed means of four cells and of H0, H1 and D = H1 - H0; a missing seed makes them null."""
    b0, b0h, b1, b1h = cells
    wide = df.groupBy(*keys, "seed").pivot(cell, list(cells)).agg(F.first(metric))
    full = wide.withColumns({"H0": F.col(b0h) - F.col(b0), "H1": F.col(b1h) - F.col(b1)}).withColumn("D", F.col("H1") - F.col("H0"))
    return complete_mean(full, keys, "seed", seeds, [*cells, "H0", "H1", "D"])


def cross_family(summary: DataFrame, keys: Sequence[str], family: str, first: str, second: str, metrics=("H0", "H1")) -> DataFrame:
    """Family ``first`` minus family ``second`` of the given contrasts."""
    wide = summary.groupBy(*keys).pivot(family, [first, second]).agg(*[F.first(m).alias(m) for m in metrics])
    return wide.select(*keys, *[(F.col(f"{first}_{m}") - F.col(f"{second}_{m}")).alias(m) for m in metrics])


def family_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per replicate: family A, the seed mean of family B, and A minus B, in long form."""
    keys = list(keys)
    left = a.select(*keys, *[F.col(m).cast("double").alias(f"_a_{m}") for m in metrics])
    right = b.select(*keys, *[F.col(m).cast("double").alias(f"_b_{m}") for m in metrics])
    rows = []
    for m in metrics:
        x, y = F.col(f"_a_{m}"), F.col(f"_b_{m}")
        rows += [
            F.struct(F.lit(m).alias("metric"), F.lit("A").alias("family"), x.alias("value")),
            F.struct(F.lit(m).alias("metric"), F.lit("B").alias("family"), y.alias("value")),
            F.struct(F.lit(m).alias("metric"), F.lit("A_minus_B").alias("family"), (x - y).alias("value")),
        ]
    return left.join(right, keys).withColumn("_r", F.explode(F.array(*rows))).select(*keys, "_r.*")


def stage_processing_effects(df: DataFrame, keys: Sequence[str], metric: str, stages=("raw", "clipped", "platt")) -> DataFrame:
    """clipped-raw, platt-clipped and platt-raw of an effect, per replicate, in long form."""
    raw, clipped, platt = stages
    wide = df.groupBy(*keys).pivot("stage", list(stages)).agg(F.first(metric))
    rows = [
        F.struct(F.lit(f"{b}_minus_{a}").alias("processing"), (F.col(b) - F.col(a)).alias("value"))
        for a, b in ((raw, clipped), (clipped, platt), (raw, platt))
    ]
    return wide.withColumn("_r", F.explode(F.array(*rows))).select(*keys, "_r.*")


def lag_diagnostics(df: DataFrame, keys: Sequence[str], label: str, lags: Sequence[int], value: str | None = None) -> DataFrame:
    """Correlation of each time group's rate (or value) with the one ``lag`` groups later.

    Works on one row per distinct time; a lag is an equi-join on the shifted position.
    """
    keys = list(keys)
    series = df.groupBy(*keys, "pos").agg(
        (F.sum(F.col(value)) if value else F.avg(F.col(label))).cast("double").alias("x"), F.count("*").alias("size")
    )
    ahead = series.withColumn("lag", F.explode(F.array(*[F.lit(int(k)) for k in lags]))).select(
        *keys, "lag", (F.col("pos") - F.col("lag")).alias("pos"), F.col("x").alias("y")
    )
    return series.join(ahead, [*keys, "pos"]).groupBy(*keys, "lag").agg(
        F.corr("x", "y").alias("correlation"), F.count("*").alias("paired_groups")
    )


def time_structure(positions: DataFrame, df: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    """Median and largest gap between distinct times, and time-group sizes."""
    keys = list(keys)
    nxt = positions.select(*keys, (F.col("pos") - 1).alias("pos"), F.col(time).alias("_next"))
    gaps = positions.join(nxt, [*keys, "pos"]).withColumn("_gap", F.col("_next") - F.col(time))
    sizes = df.groupBy(*keys, time).agg(F.count("*").alias("_size"))
    return gaps.groupBy(*keys).agg(
        F.percentile("_gap", F.lit(0.5)).alias("gap_median"), F.max("_gap").alias("gap_max")
    ).join(
        sizes.groupBy(*keys).agg(
            F.count("*").alias("time_groups"), F.percentile("_size", F.lit(0.5)).alias("size_median"), F.max("_size").alias("size_max")
        ),
        keys,
    )


def block_span_summary(positions: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    """Elapsed time covered by every eligible default block: min, median, max."""
    keys = list(keys)
    sized = positions.withColumn("block_length", default_block(F.col("groups")))
    ends = positions.select(*keys, F.col("pos").alias("_end"), F.col(time).alias("_end_time"))
    spans = sized.withColumn("_end", F.col("pos") + F.col("block_length") - 1).join(ends, [*keys, "_end"])
    span = F.col("_end_time") - F.col(time)
    return spans.groupBy(*keys, "groups", "block_length").agg(
        F.count("*").alias("eligible_blocks"), F.min(span).alias("span_min"),
        F.percentile(span, F.lit(0.5)).alias("span_median"), F.max(span).alias("span_max"),
    )


def draw_distribution(values: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Minimum, maximum, mean and quantiles of stored replicate values."""
    return values.groupBy(*keys).agg(
        F.count(column).alias("draws"), F.min(column).alias("minimum"), F.max(column).alias("maximum"), F.avg(column).alias("mean"),
        F.percentile(column, F.lit(0.5)).alias("median"), F.percentile(column, F.lit(0.025)).alias("q025"), F.percentile(column, F.lit(0.975)).alias("q975"),
    )


def version_paired_intervals(old: DataFrame, new: DataFrame, keys: Sequence[str], metrics: Sequence[str], group: Sequence[str]) -> DataFrame:
    """New minus old implementation on the same draws: interval, and how many values changed."""
    keys = list(keys)
    a, b = melt(old, keys, metrics), melt(new, keys, metrics).withColumnRenamed("value", "_new")
    paired = a.join(b, [*keys, "metric"], "full").withColumn("_gap", F.col("_new") - F.col("value"))
    changed = paired.groupBy(*group, "metric").agg(
        F.sum((~F.col("_new").eqNullSafe(F.col("value"))).cast("bigint")).alias("changed"), F.max(F.abs("_gap")).alias("max_difference")
    )
    return interval_summary(paired, [*group, "metric"], value="_gap").join(changed, [*group, "metric"])


def observed_effects(points: DataFrame, keys: Sequence[str], baseline: str, candidate: str, fn_cost: float = 100.0) -> DataFrame:
    """Un-resampled effects beside the intervals, from one row of counts per model."""
    keys = list(keys)
    fields = ("rows", "positives", "tp", "fp", "pr_auc")
    a = points.where(F.col("model") == baseline).select(*keys, *[F.col(c).alias(f"_a_{c}") for c in fields])
    b = points.where(F.col("model") == candidate).select(*keys, *[F.col(c).alias(f"_b_{c}") for c in fields])
    x, y = (lambda m: F.col(f"_a_{m}")), (lambda m: F.col(f"_b_{m}"))
    saved = F.lit(float(fn_cost)) * (y("tp") - x("tp")) + (x("fp") - y("fp"))
    return a.join(b, keys).select(
        *keys,
        safe_divide(y("tp") - x("tp"), x("positives")).alias("delta_recall"),
        saved.alias("cost_reduction"),
        (saved * F.lit(100000.0) / x("rows")).alias("cost_reduction_per_100k"),
        safe_divide(saved, F.lit(float(fn_cost)) * x("positives")).alias("delta_cost_saving_rate"),
        (y("pr_auc") - x("pr_auc")).alias("delta_pr_auc"),
    )
