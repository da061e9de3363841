"""Calibration maps, reliability tables, tie and stage audits, decision comparisons."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.prefix import (
    default_ranges,
    ordered_quantiles,
    quantile_columns,
    running,
    settle,
    value_edges,
    with_range,
)
from riskframe.functions.scalars import CLIP, bounded, checked_score, clip_score, defined, expit, logit, platt_score, safe_divide
from riskframe.operators.decisions import apply_threshold, bayes_capacity, operating_points, optimize_threshold
from riskframe.operators.metrics import (
    LEVELS,
    EPS,
    average_precision,
    confusion,
    cost_fields,
    curve_ap,
    rates,
    score_curve,
    score_levels,
)


#: Smallest slope of a logistic map: it keeps the order of scores.
LEAST_SLOPE = 1e-6

# ---- fitted maps -------------------------------------------------------------------------------


def platt_fit(df: DataFrame, score: str, label: str) -> tuple[float, float]:
    """Slope and intercept of a logistic map on the clipped logit; the slope is kept positive.

    The fit runs on score levels with their counts as weights.
    """
    levels = df.groupBy(score, label).agg(F.count("*").cast("double").alias("_w"))
    rows = levels.select(logit(clip_score(F.col(score))).alias("_z"), F.col(label).cast("double").alias("_y"), "_w")
    vectors = VectorAssembler(inputCols=["_z"], outputCol="_x").transform(rows)
    model = LogisticRegression(
        featuresCol="_x", labelCol="_y", weightCol="_w", regParam=0.0, standardization=False, maxIter=200, tol=1e-10,
        lowerBoundsOnCoefficients=DenseMatrix(1, 1, [LEAST_SLOPE]),
    ).fit(vectors)
    return float(model.coefficients[0]), float(model.intercept)


def platt_fit_cells(df: DataFrame, keys: Sequence[str], score: str, label: str, most: int = 30) -> DataFrame:
    """Slope and intercept of ``platt_fit`` for every key at once: (keys, slope, intercept).

    Newton steps on score levels: one grouped sum of the score equations per step serves all cells,
    however many. A slope that would fall below its bound stays there and the intercept follows.
    ``label`` may be ``LEVELS``.
    """
    keys = list(keys)
    z = logit(clip_score(checked_score(F.col(score))))
    if label == LEVELS:
        classes = F.array(*[F.struct(F.lit(y).alias("y"), n.alias("n")) for y, n in ((1.0, F.col("pos")), (0.0, F.col("n") - F.col("pos")))])
        told = df.select(*keys, z.alias("_z"), F.explode(classes).alias("_c")).where("_c.n > 0").groupBy(*keys, "_z", F.col("_c.y").alias("_y"))
        levels = settle(told.agg(F.sum("_c.n").cast("double").alias("_w")))
    else:
        levels = settle(df.groupBy(*keys, z.alias("_z"), F.col(label).cast("double").alias("_y")).agg(F.count("*").cast("double").alias("_w")))
    fit = settle(levels.select(*keys).distinct().withColumns({"slope": F.lit(0.0), "intercept": F.lit(0.0), "_step": F.lit(1.0)}))
    p = expit(F.col("slope") * F.col("_z") + F.col("intercept"))
    z, w = F.col("_z"), F.col("_w")
    error, spread = w * (p - F.col("_y")), w * p * (1 - p)
    terms = {"g0": error, "g1": error * z, "h00": spread, "h01": spread * z, "h11": spread * z * z}
    g0, g1, h00, h01, h11 = (F.col(c) for c in terms)
    det = h00 * h11 - h01 * h01
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    for _ in range(most):
        sums = levels.join(fit, keys).groupBy(*keys, "slope", "intercept").agg(*[F.sum(v).alias(c) for c, v in terms.items()])
        free = F.col("slope") - part(h00 * g1 - h01 * g0, det)
        slope = F.greatest(F.lit(LEAST_SLOPE), free)
        bound = F.col("intercept") - part(g0 + h01 * (slope - F.col("slope")), h00)
        intercept = F.when(free >= LEAST_SLOPE, F.col("intercept") - part(h11 * g0 - h01 * g1, det)).otherwise(bound)
        step = F.abs(slope - F.col("slope")) + F.abs(intercept - F.col("intercept"))
        fit = settle(sums.select(*keys, slope.alias("slope"), intercept.alias("intercept"), step.alias("_step")))
        if (fit.agg(F.max("_step")).first()[0] or 0.0) < 1e-10:
            break
    return fit.drop("_step")


def platt_apply_cells(df: DataFrame, keys: Sequence[str], score: str, fitted: DataFrame, output: str = "platt") -> DataFrame:
    """Calibrated score by the map of each row's key."""
    value = expit(F.col("slope") * logit(clip_score(F.col(score))) + F.col("intercept"))
    return df.join(fitted, list(keys)).withColumn(output, value).drop("slope", "intercept")


def platt_apply(df: DataFrame, score: str, coefficients: tuple[float, float], output: str = "platt") -> DataFrame:
    return df.withColumn(output, platt_score(F.col(score), *coefficients))


def _pool(blocks: pd.DataFrame) -> list[list]:
    """(low, high, n, pos) of pooled neighbours whose rates did not rise; compared as integers."""
    pooled: list[list] = []
    for low, high, n, pos in zip(*(blocks[c].tolist() for c in ("low", "high", "n", "pos"))):
        while pooled and pooled[-1][3] * n >= pos * pooled[-1][2]:
            low, _, before_n, before_pos = pooled.pop()
            n, pos = n + before_n, pos + before_pos
        pooled.append([low, high, n, pos])
    return pooled


#: Denominator of the rates at which an isotonic map is cut into classes.
_RATE = 1_000_000_000


def _class_cuts(pooled: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """Per key the running row counts at which its isotonic map first reaches each of about ``classes - 1`` rates.

    A map reaches the rate r where cumulated positives minus r times cumulated rows is least, over all
    block starts. Inside a range pooled blocks rise, so there the least is at the first block that
    reaches r, or at the range's end: every (range, rate) offers two points at most, and a grouped minimum
    in integers finds the place, the earliest on ties.
    """
    rate = F.floor(F.col("pos") * F.lit(_RATE) / F.col("n")).cast("long")
    asked = pooled.groupBy(*keys).agg(F.percentile_approx(rate, [i / classes for i in range(1, classes)], 1000).alias("_r"))
    asked = settle(asked.select(*keys, F.array_distinct("_r").alias("_rates")))
    inside = Window.partitionBy(*keys, "_range").orderBy("low")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    placed = pooled.join(asked, list(keys)).withColumns(
        {"_bn": F.lag("n").over(inside), "_bp": F.lag("pos").over(inside), "_last": F.lead("n").over(inside).isNull()}
    )
    reached = lambda r, n, pos: r.cast("decimal(38,0)") * n <= pos * F.lit(_RATE).cast("decimal(38,0)")
    first = F.filter("_rates", lambda r: reached(r, wide("n"), wide("pos")) & ~F.coalesce(reached(r, wide("_bn"), wide("_bp")), F.lit(False)))
    never = F.filter("_rates", lambda r: F.col("_last") & ~reached(r, wide("n"), wide("pos")))
    points = F.concat(
        F.transform(first, lambda r: F.struct(r.alias("rate"), F.col("before_n").alias("at"), F.col("before_pos").alias("p"))),
        F.transform(never, lambda r: F.struct(r.alias("rate"), (F.col("before_n") + F.col("n")).alias("at"), (F.col("before_pos") + F.col("pos")).alias("p"))),
    )
    offered = placed.select(*keys, F.explode(points).alias("o")).select(*keys, "o.*")
    gap = wide("p") * F.lit(_RATE).cast("decimal(38,0)") - wide("rate") * wide("at")
    cuts = offered.groupBy(*keys, "rate").agg(F.min(F.struct(gap.alias("gap"), F.col("at"))).alias("m"))
    return settle(cuts.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.collect_list("m.at"))).alias("_cuts")))


def isotonic_fit(df: DataFrame, keys: Sequence[str], score: str, label: str, classes: int | None = None) -> DataFrame:
    """Isotonic map of every key at once: its blocks as rows (keys, block, low, high, isotonic, next_low, next_isotonic).

    Neighbouring levels whose rates do not rise are pooled, in integers, twice. First inside (key, score
    range). Then inside (key, class): the map is cut where it reaches certain rates, found by
    ``_class_cuts`` before the map is known, and no block crosses such a cut. Both are spread over as
    many tasks as the session shuffles into, so no key ends in one task, however many levels remain.
    """
    keys = list(keys)
    levels = settle(score_levels(df, keys, score, label))
    ranged = with_range(levels, score, value_edges(levels, score), "_range")
    typed = ranged.select(*keys, "_range", F.col(score).cast("double").alias("low"), F.col(score).cast("double").alias("high"), "n", "pos")
    kinds = ", ".join(f"`{k}` {typed.schema[k].dataType.simpleString()}" for k in keys)

    def pool(part: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_pool(part.sort_values("low")), columns=["low", "high", "n", "pos"])
        own = [c for c in part.columns if c in keys or c in ("_range", "_class")]
        return out.assign(**{k: part[k].iloc[0] for k in own})

    schema = f"low double, high double, n bigint, pos bigint, {kinds}"
    pooled = settle(running(typed.groupBy(*keys, "_range").applyInPandas(pool, f"{schema}, _range double"), keys, "low", "_range", sums=["n", "pos"]))
    cuts = _class_cuts(pooled, keys, classes or max(2, default_ranges(df)))
    place = F.size(F.filter("_cuts", lambda at: at <= F.col("before_n"))).alias("_class")
    cut = pooled.join(cuts, keys).select(*keys, "low", "high", "n", "pos", place)
    blocks = settle(cut.groupBy(*keys, "_class").applyInPandas(pool, f"{schema}, _class int"))

    along = Window.partitionBy(*keys).orderBy("_class")  # one row per class
    each = blocks.groupBy(*keys, "_class").agg(F.count("*").alias("_n"), F.min(F.struct("low", (F.col("pos") / F.col("n")).alias("isotonic"))).alias("_first"))
    each = each.select(*keys, "_class", F.lead("_first").over(along).alias("_after"), (F.sum("_n").over(along) - F.col("_n")).alias("_offset"))
    inside = Window.partitionBy(*keys, "_class").orderBy("low")
    fitted = blocks.withColumn("isotonic", F.col("pos") / F.col("n")).join(each, [*keys, "_class"])
    return settle(
        fitted.select(
            *keys,
            (F.col("_offset") + F.row_number().over(inside)).alias("block"),
            "low",
            "high",
            "isotonic",
            F.coalesce(F.lead("low").over(inside), F.col("_after.low")).alias("next_low"),
            F.coalesce(F.lead("isotonic").over(inside), F.col("_after.isotonic")).alias("next_isotonic"),
        )
    )


def isotonic_apply(
    df: DataFrame, keys: Sequence[str], score: str, fitted: DataFrame, output: str = "isotonic", levels: DataFrame | None = None
) -> DataFrame:
    """Calibrated score by the map of each row's key: a block's rate, linear between blocks, level beyond the ends.

    Null where the score is undefined or the key has no map. The block of a score is the running
    count of block starts over written levels, so no key is worked out in one task. ``levels`` may
    name a table that holds every (key, score) of the rows already.
    """
    keys = list(keys)
    asked = (df if levels is None else levels).where(defined(F.col(score))).select(*keys, F.col(score).cast("double").alias("_x")).distinct()
    marks = asked.select(*keys, "_x", F.lit(0).alias("_start")).unionByName(fitted.select(*keys, F.col("low").alias("_x"), F.lit(1).alias("_start")))
    marks = settle(marks.groupBy(*keys, "_x").agg(F.sum("_start").alias("_start")))
    placed = running(with_range(marks, "_x", value_edges(marks, "_x"), "_range"), keys, "_x", "_range", sums=["_start"])
    placed = placed.select(*keys, "_x", F.greatest(F.lit(1), F.col("before__start") + F.col("_start")).alias("block"))
    slope = (F.col("next_isotonic") - F.col("isotonic")) / (F.col("next_low") - F.col("high"))
    value = F.when((F.col("_x") > F.col("high")) & F.col("next_low").isNotNull(), F.col("isotonic") + slope * (F.col("_x") - F.col("high")))
    mapped = placed.join(fitted, [*keys, "block"]).select(*keys, F.col("_x").alias("_score"), bounded(value.otherwise(F.col("isotonic"))).alias("_value"))
    rows = df.withColumn("_score", F.col(score).cast("double"))
    return rows.join(settle(mapped), [*keys, "_score"], "left").withColumn(output, F.col("_value")).drop("_score", "_value")


# ---- reliability -------------------------------------------------------------------------------


def reliability_bins(df: DataFrame, keys: Sequence[str], score: str, label: str, method: str = "uniform", bins: int = 10) -> DataFrame:
    """Rows, positives, mean score and observed rate per bin.

    Bins are closed on the left, the last one on both sides. Uniform bins are all listed;
    quantile bins only where filled, after equal edges are merged.
    """
    if bins < 2 or not keys:
        raise ValueError("at least two bins and one key column")
    keys = list(keys)
    inside = df.withColumn("_p", bounded(F.col(score)))
    levels = score_levels(inside, keys, "_p", label)
    if method == "uniform":
        step = 1.0 / bins
        edges = [i * step for i in range(bins)] + [1.0]
        index = sum(((F.col("_p") >= F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(0))
        marked = levels.withColumns({"bin_id": index, "_edges": F.array(*[F.lit(e) for e in edges])})
    elif method == "quantile":
        found = ordered_quantiles(inside, keys, "_p", [i / bins for i in range(bins + 1)], weight="n" if label == LEVELS else None)
        cut = found.groupBy(*keys).agg(F.array_sort(F.collect_set("value")).alias("_edges"))
        joined = levels.join(settle(cut), keys)
        inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
        marked = joined.withColumn("bin_id", F.size(F.filter(inner, lambda e: e <= F.col("_p"))))
    else:
        raise ValueError("method must be uniform or quantile")
    summed = marked.groupBy(*keys, "bin_id").agg(
        F.first("_edges").alias("_edges"),
        F.sum("n").alias("sample_count"),
        F.sum("pos").alias("positive_count"),
        F.sum(F.col("_p") * F.col("n")).alias("_sum"),
    )
    if method == "uniform":
        grid = summed.select(*keys).distinct().withColumn("bin_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        summed = grid.join(summed, [*keys, "bin_id"], "left").withColumn("_edges", F.array(*[F.lit(e) for e in edges]))
    count = F.coalesce("sample_count", F.lit(0))
    upper = F.try_element_at("_edges", F.col("bin_id") + 2)
    return summed.select(
        *keys,
        "bin_id",
        F.element_at("_edges", F.col("bin_id") + 1).alias("bin_lower"),
        F.coalesce(upper, F.element_at("_edges", F.col("bin_id") + 1) * F.lit(1 + EPS)).alias("bin_upper"),
        count.alias("sample_count"),
        F.coalesce("positive_count", F.lit(0)).alias("positive_count"),
        safe_divide(F.col("_sum"), count).alias("mean_predicted"),
        safe_divide(F.col("positive_count"), count).alias("observed_rate"),
    )


def ece_from_bins(table: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Expected calibration error and bin-quality diagnostics."""
    filled = table.where(F.col("sample_count") > 0)
    gap = F.abs(F.col("observed_rate") - F.col("mean_predicted")) * F.col("sample_count")
    return filled.groupBy(*keys).agg(
        (F.sum(gap) / F.sum("sample_count")).alias("ece"),
        F.count("*").alias("filled_bins"),
        (F.lit(bins) - F.count("*")).alias("empty_bins"),
        (F.max("sample_count") / F.sum("sample_count")).alias("largest_share"),
        F.min("sample_count").alias("smallest_bin"),
        F.max("sample_count").alias("largest_bin"),
    )


def ece(df, keys, score, label, method: str = "uniform", bins: int = 10) -> DataFrame:
    return ece_from_bins(reliability_bins(df, keys, score, label, method, bins), keys, bins)


def probability_metrics(df: DataFrame, keys: Sequence[str], score: str, label: str, ap: bool = True) -> DataFrame:
    """Brier score, log loss under one clip, and AP."""
    keys = list(keys)
    inside = df.withColumn("_p", bounded(F.col(score)))
    levels = score_levels(inside, keys, "_p", label)
    p, pos, neg = F.col("_p"), F.col("pos"), F.col("n") - F.col("pos")
    clipped = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    out = levels.groupBy(*keys).agg(
        (F.sum(pos * (1 - p) * (1 - p) + neg * p * p) / F.sum("n")).alias("brier"),
        (-F.sum(pos * F.ln(clipped) + neg * F.ln(1 - clipped)) / F.sum("n")).alias("log_loss"),
    )
    return out.join(average_precision(inside, keys, "_p", label), keys) if ap else out


def tie_statistics(df: DataFrame, keys: Sequence[str], score: str, label: str | None = None) -> DataFrame:
    rows = F.sum("n") if label == LEVELS else F.count("*")
    levels = df.groupBy(*keys, score).agg(rows.alias("n"))
    tied = F.when(F.col("n") > 1, F.col("n")).otherwise(0)
    return levels.groupBy(*keys).agg(
        F.count("*").alias("unique_outputs"),
        F.sum((F.col("n") > 1).cast("bigint")).alias("tied_groups"),
        F.sum(tied).cast("bigint").alias("tied_rows"),
        (F.sum(tied) / F.sum("n")).alias("tie_fraction"),
        F.max("n").alias("largest_tie"),
        (F.max("n") / F.sum("n")).alias("largest_share"),
        (F.sum(F.when(F.col(score) == 0.0, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_zero"),
        (F.sum(F.when(F.col(score) == 1.0, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_one"),
    )


def _times(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1).cast("bigint")


def boundary_percentile(df: DataFrame, keys: Sequence[str], raw: str, selected: str, weight: str | None = None) -> DataFrame:
    """Share of rows whose raw score is at most the lowest selected one; 1 if none is selected. ``weight``: rows a row stands for."""
    keys = list(keys)
    low = settle(df.where(F.col(selected) == 1).groupBy(*keys).agg(F.min(raw).alias("_low")))
    under, times = (F.col(raw) <= F.col("_low")).cast("bigint"), _times(weight)
    share = safe_divide(F.sum(under * times), F.sum(F.when(under.isNotNull(), times)))
    return df.join(low, keys, "left").groupBy(*keys).agg(F.coalesce(share, F.lit(1.0)).alias("boundary_percentile"))


def jaccard(df: DataFrame, keys: Sequence[str], a: str, b: str, weight: str | None = None) -> DataFrame:
    """Overlap of two decision columns, with their disagreement. ``weight``: rows a row stands for."""
    rows = lambda of: F.sum(of.cast("bigint") * _times(weight))
    both, either = rows((F.col(a) == 1) & (F.col(b) == 1)), rows((F.col(a) == 1) | (F.col(b) == 1))
    differ = rows(F.col(a) != F.col(b))
    return df.groupBy(*keys).agg(
        F.coalesce(safe_divide(both, either), F.lit(1.0)).alias("jaccard"),
        differ.alias("disagreements"),
        (differ / F.sum(_times(weight))).alias("disagreement_rate"),
    )


def average_ranks(df: DataFrame, keys: Sequence[str], column: str, output: str, weight: str | None = None) -> DataFrame:
    """Level table (keys, column, average ascending rank). ``weight``: rows a row stands for."""
    levels = df.groupBy(*keys, column).agg(F.sum(_times(weight)).alias("n"))
    ranged = with_range(levels, column, value_edges(df, column), "_range")
    placed = running(ranged, keys, column, "_range", sums=["n"])
    return placed.select(*keys, column, (F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)).alias(output))


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, weight: str | None = None) -> DataFrame:
    """Rank correlation from average ranks. Rows are read once, into written (a, b) level pairs, which all else reads."""
    keys = list(keys)
    pairs = settle(df.groupBy(*keys, a, b).agg(F.sum(_times(weight)).alias("_w")))
    ranked = pairs.join(average_ranks(pairs, keys, a, "_ra", "_w"), [*keys, a]).join(average_ranks(pairs, keys, b, "_rb", "_w"), [*keys, b])
    w, x, y = F.col("_w"), F.col("_ra"), F.col("_rb")
    sums = ranked.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
        F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"),
    )
    top = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    under = F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")))
    return sums.select(*keys, safe_divide(top, under).alias("spearman"))


# ---- stages ------------------------------------------------------------------------------------


def same_ordered_partition(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Do two score columns tie and order the rows identically?"""
    audit = monotone_merge_audit(df, keys, a, b)
    same = (F.col("violations") == 0) & (F.col("merged_groups") == 0)
    return audit.select(*keys, same.cast("int").alias("same_partition"))


def monotone_merge_audit(df: DataFrame, keys: Sequence[str], previous: str, current: str) -> DataFrame:
    """Is ``current`` weakly rising in ``previous``, and how many score groups did it merge?"""
    keys = list(keys)
    spans = df.groupBy(*keys, previous).agg(F.min(current).alias("_lo"), F.max(current).alias("_hi"))
    ranged = with_range(spans, previous, value_edges(df, previous), "_range")
    placed = running(ranged, keys, previous, "_range", maxima=["_hi"])
    falls = F.coalesce(F.col("before__hi") > F.col("_lo"), F.lit(False)) | (F.col("_hi") > F.col("_lo"))
    monotone = placed.groupBy(*keys).agg(
        F.count("*").alias("input_unique"), F.sum(falls.cast("bigint")).alias("violations")
    )
    out = df.groupBy(*keys).agg(F.countDistinct(current).alias("output_unique"))
    return monotone.join(out, keys).select(
        *keys,
        "input_unique",
        "output_unique",
        (F.col("violations") == 0).cast("int").alias("weakly_monotone"),
        (F.col("input_unique") - F.col("output_unique")).alias("merged_groups"),
        "violations",
    )


def stage_audit(df: DataFrame, keys: Sequence[str], label: str, stages: Sequence[str] = ("raw", "clipped", "platt")) -> DataFrame:
    """AP and distinct scores per stage, clip counts, and whether clipped and platt order alike."""
    keys = list(keys)
    out = df.groupBy(*keys).agg(
        F.sum((F.col(stages[0]) <= CLIP).cast("bigint")).alias("low_clipped"),
        F.sum((F.col(stages[0]) >= 1 - CLIP).cast("bigint")).alias("high_clipped"),
    )
    for s in stages:
        part = score_curve(df, keys, s, label).groupBy(*keys).agg(curve_ap().alias(f"{s}_ap"), F.count("*").alias(f"{s}_unique"))
        out = out.join(part, keys)
    return out.join(same_ordered_partition(df, keys, stages[1], stages[2]), keys)


def constant_reference(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Brier score and log loss of predicting the base rate everywhere."""
    base = df.groupBy(*keys).agg(F.avg(label).alias("rate"))
    r = F.col("rate")
    c = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), r))
    return base.select(*keys, "rate", (r * (1 - r)).alias("brier"), (-(r * F.ln(c) + (1 - r) * F.ln(1 - c))).alias("log_loss"))


def score_difference(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Absolute difference of two scores: max, mean, median, p95, equal and unequal rows."""
    keys = list(keys)
    gaps = df.withColumn("_gap", F.abs(F.col(a) - F.col(b)))
    whole = gaps.groupBy(*keys).agg(
        F.max("_gap").alias("max_difference"),
        F.avg("_gap").alias("mean_difference"),
        F.sum((F.col("_gap") == 0).cast("bigint")).alias("equal_rows"),
        F.sum((F.col("_gap") != 0).cast("bigint")).alias("different_rows"),
    )
    middle = quantile_columns(gaps, keys, "_gap", {"median_difference": 0.5, "p95_difference": 0.95})
    return whole.join(middle, keys)


# ---- one branch, and branches compared ---------------------------------------------------------


def evaluate_branch(
    validation: DataFrame,
    test: DataFrame,
    keys: Sequence[str],
    score: str,
    raw: str,
    label: str,
    fn_cost: float = 100.0,
    fp_cost: float = 1.0,
    capacity: float = 0.03,
    tie_methods: Sequence[str] = ("Isotonic",),
) -> DataFrame:
    """Calibration branches end to end: threshold on validation, report on test, reliability on both.

    The rows carry their ``method`` as one of the keys, so all methods share each pass. Each side is
    summed to (raw, score) levels once, and written; thresholds, confusion, Brier score, log loss, AP,
    bins, quantiles and ties all read levels, and no step reads the rows again. ``label`` may be ``LEVELS``.
    Tie fields are null for methods outside ``tie_methods``.
    """
    keys = list(keys)
    test = test.withColumn(raw, checked_score(F.col(raw)))
    rv, rt = (settle(score_levels(rows, [*keys, raw], score, label)) for rows in (validation, test))
    lv, lt = (settle(score_levels(levels, keys, score, LEVELS)) for levels in (rv, rt))
    chosen = settle(optimize_threshold(lv, keys, score, LEVELS, fn_cost, fp_cost, max_alert_rate=capacity))
    decided = apply_threshold(lt, score, chosen, keys)
    hit, pos, neg = F.col("alert") == 1, F.col("pos"), F.col("n") - F.col("pos")
    cell = lambda rows, alert: F.coalesce(F.sum(F.when(alert, rows)), F.lit(0))
    report = decided.groupBy(*keys).agg(
        cell(neg, ~hit).alias("tn"), cell(neg, hit).alias("fp"), cell(pos, ~hit).alias("fn"), cell(pos, hit).alias("tp")
    )
    kept = {k: v for k, v in rates(fn_cost, fp_cost).items() if k in ("precision", "recall", "f1", "alert_rate")}
    out = report.withColumns(kept).withColumns(cost_fields(fn_cost, fp_cost)).withColumns(
        {"capacity_deviation": F.col("alert_rate") - F.lit(capacity), "capacity_deviation_abs": F.abs(F.col("alert_rate") - F.lit(capacity))}
    )
    ties = tie_statistics(lt, keys, score, LEVELS)
    fields = ("unique_outputs", "tied_rows", "tie_fraction", "largest_tie")
    parts = [
        chosen.select(*keys, "threshold", safe_divide(F.col("alerts"), F.col("rows")).alias("validation_alert_rate"), F.col("cost").alias("validation_cost")),
        operating_points(lv, keys, score, LEVELS).groupBy(*keys).agg(F.count("*").alias("threshold_candidates")),
        boundary_percentile(apply_threshold(rv, score, chosen, keys), keys, raw, "alert", "n"),
        probability_metrics(lv, keys, score, LEVELS, ap=False).select(*keys, F.col("brier").alias("val_brier"), F.col("log_loss").alias("val_log_loss")),
        probability_metrics(lt, keys, score, LEVELS).select(
            *keys, F.col("brier").alias("test_brier"), F.col("log_loss").alias("test_log_loss"), F.col("ap").alias("calibrated_ap")
        ),
        average_precision(rt, keys, raw, LEVELS).select(*keys, F.col("ap").alias("raw_ap")),
        quantile_columns(lt, keys, score, {"score_p99": 0.99, "score_p999": 0.999}, weight="n"),
        ties.select(*keys, *[F.when(F.col("method").isin(*tie_methods), F.col(c)).alias(c) for c in fields]),
    ]
    for name, rows in (("val", lv), ("test", lt)):
        for how in ("uniform", "quantile"):
            parts.append(ece(rows, keys, score, LEVELS, how).select(*keys, F.col("ece").alias(f"{name}_ece_{how}")))
    for part in parts:
        out = out.join(part, keys)
    return out


def compare_decisions(
    validation: DataFrame, test: DataFrame, results: DataFrame, keys: Sequence[str], scores: dict[str, str], baseline: str, weight: str | None = None
) -> DataFrame:
    """Each method against the uncalibrated one: rank correlation, overlap and metric changes.

    ``validation`` and ``test`` hold the score of each method in the column that ``scores`` names, so two decisions
    on a row meet without a join by id; ``weight`` names the rows that a row stands for. ``results`` holds one row per (keys, method).
    """
    keys = list(keys)
    both = [*keys, "method"]
    cut = {m: f"_cut_{i}" for i, m in enumerate(scores)}
    cuts = settle(results.groupBy(*keys).agg(*[F.max(F.when(F.col("method") == m, F.col("threshold"))).alias(c) for m, c in cut.items()]))
    alert = lambda m: (defined(F.col(scores[m])) & (F.col(scores[m]) >= F.col(cut[m]))).cast("int")
    old = [F.col(cut[baseline]).alias("_old"), alert(baseline).alias("_a"), F.col(scores[baseline]).alias("_sa")]
    pairs = F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(cut[m]).alias("_new"), alert(m).alias("_b"), F.col(scores[m]).alias("_sb"), *old)
        for m in scores if m != baseline
    ])
    out = None
    for name, rows in (("validation", validation), ("test", test)):
        met = rows.join(cuts, keys).select(*keys, _times(weight).alias("_n"), F.explode(pairs).alias("_p")).select(*keys, "_n", "_p.*")
        met = met.where(F.col("_old").isNotNull() & F.col("_new").isNotNull())
        met = settle(met.groupBy(*both, "_a", "_b", "_sa", "_sb").agg(F.sum("_n").alias("_n")))
        side = jaccard(met, both, "_a", "_b", "_n")
        side = side.select(*both, *[F.col(c).alias(f"{name}_{c}") for c in ("jaccard", "disagreements", "disagreement_rate")])
        if name == "validation":
            side = side.join(spearman(met, both, "_sa", "_sb", "_n"), both)
        out = side if out is None else out.join(side, both)
    fields = ("recall", "fp", "fn", "business_cost", "alert_rate", "calibrated_ap")
    base = results.where(F.col("method") == baseline).select(*keys, *[F.col(c).alias(f"_old_{c}") for c in fields])
    change = results.where(F.col("method") != baseline).join(base, keys)
    change = change.select(*both, *[(F.col(c) - F.col(f"_old_{c}")).alias(f"{c}_difference") for c in fields])
    return (
        change.join(out, both)
        .withColumn("comparison", F.concat(F.col("method"), F.lit(f" vs {baseline}")))
        .drop("method")
    )


def compare_reliability(results: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Improvement of each method over another in Brier, ECE, log loss, cost and capacity drift."""
    fields = {
        "brier_improvement": "test_brier",
        "ece_uniform_improvement": "test_ece_uniform",
        "ece_quantile_improvement": "test_ece_quantile",
        "log_loss_improvement": "test_log_loss",
        "cost_reduction": "business_cost",
        "capacity_improvement": "capacity_deviation_abs",
    }
    keys = list(keys)
    names = sorted({m for p in pairs for m in p})
    wide = results.groupBy(*keys).pivot("method", names).agg(*[F.first(c).alias(c) for c in fields.values()])
    rows = [
        F.struct(
            F.lit(f"{a} vs {b}").alias("comparison"),
            *[(F.col(f"{b}_{c}") - F.col(f"{a}_{c}")).alias(n) for n, c in fields.items()],
        )
        for a, b in pairs
    ]
    return wide.withColumn("_r", F.explode(F.array(*rows))).select(*keys, "_r.*")


def calibration_summary(results: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, deviation, minimum and maximum over seeds, and the threshold's relative spread."""
    aggregates = []
    for m in metrics:
        aggregates += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    out = results.groupBy(*keys).agg(*aggregates)
    if "threshold" in metrics:
        center = F.abs(F.col("threshold_mean"))
        out = out.withColumn("threshold_cv", F.when(center > EPS, F.col("threshold_std") / center))
    return out


def bayes_branch(df, keys, score, raw, label, identity, threshold, capacity, fn_cost, fp_cost):
    """Threshold-then-capacity decisions with their cost report."""
    from riskframe.operators.decisions import bayes_summary
    from riskframe.operators.metrics import decision_metrics

    decided = bayes_capacity(df, keys, score, raw, label, identity, threshold, capacity)
    summary = bayes_summary(df, decided, keys, score, threshold)
    return decision_metrics(decided, keys, label, "selected", fn_cost, fp_cost).drop("alert_rate").join(summary, list(keys))
