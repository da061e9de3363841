"""Alert decisions under cost and review capacity, exact down to the tie at the boundary.

Undefined scores (null, NaN, infinite): choosing a threshold or profiling a capacity raises an error.
A decision on rows keeps such rows, never alerts on them, and gives them no part of the review budget;
``invalid_scores`` counts them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.prefix import hash_range, rank_rows, rank_within, settle, value_edges, with_range
from riskframe.functions.scalars import bounded, defined, hash_priority, review_slots, safe_divide
from riskframe.operators.metrics import EPS, score_curve


def operating_points(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Every distinct threshold with its counts, and the point that alerts on nothing."""
    keys = list(keys)
    curve = score_curve(df.withColumn("_p", bounded(F.col(score))), keys, "_p", label)
    cuts = curve.select(
        *keys, F.col("_p").alias("threshold"), "alerts", "tp", F.col("total_n").alias("rows"), F.col("total_pos").alias("positives")
    )
    top = curve.groupBy(*keys).agg(
        F.max("_p").alias("_m"), F.max("total_n").alias("rows"), F.max("total_pos").alias("positives")
    )
    none = top.select(
        *keys,
        F.greatest(F.col("_m") * F.lit(1.0 + EPS), F.lit(math.ulp(0.0))).alias("threshold"),
        F.lit(0).cast("bigint").alias("alerts"),
        F.lit(0).cast("bigint").alias("tp"),
        "rows",
        "positives",
    )
    return cuts.unionByName(none)


def _priced(points: DataFrame, fn_cost, fp_cost) -> DataFrame:
    fn = F.col("positives") - F.col("tp")
    fp = F.col("alerts") - F.col("tp")
    return points.withColumns({"fn": fn, "fp": fp, "cost": fn_cost * fn + fp_cost * fp})


def _best(keys: Sequence[str]):
    order = F.struct(F.col("cost"), -F.col("tp"), F.col("alerts"), -F.col("threshold"))
    pick = F.struct("threshold", "cost", "tp", "fp", "fn", "alerts", "rows", "positives")
    return F.min_by(pick, order).alias("b")


def optimize_threshold(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    label: str,
    fn_cost: float,
    fp_cost: float = 1.0,
    max_fnr: float | None = None,
    max_fpr: float | None = None,
    max_alert_rate: float | None = None,
    min_precision: float | None = None,
) -> DataFrame:
    """Cheapest threshold over all distinct scores under the given limits.

    Ties go to more true positives, then fewer alerts, then the higher threshold. A key without a
    feasible point, or without both classes, has no row; ``require_feasible`` turns that into an error.
    """
    for limit in (max_fnr, max_fpr, max_alert_rate, min_precision):
        if limit is not None and not 0 <= limit <= 1:
            raise ValueError("limits must lie in [0, 1]")
    points = _priced(operating_points(df, keys, score, label), F.lit(float(fn_cost)), F.lit(float(fp_cost)))
    p, n, k = F.col("positives"), F.col("rows"), F.col("alerts")
    keep = (p > 0) & (p < n)
    if max_fnr is not None:
        keep = keep & (safe_divide(F.col("fn"), p) <= max_fnr)
    if max_fpr is not None:
        keep = keep & (safe_divide(F.col("fp"), n - p) <= max_fpr)
    if max_alert_rate is not None:
        keep = keep & (safe_divide(k, n) <= max_alert_rate)
    if min_precision is not None:
        keep = keep & (F.coalesce(safe_divide(F.col("tp"), k), F.lit(0.0)) >= min_precision)
    return points.where(keep).groupBy(*keys).agg(_best(keys)).select(*keys, "b.*")


def require_feasible(chosen: DataFrame, expected_keys: int) -> DataFrame:
    if chosen.count() != expected_keys:
        raise ValueError("no threshold satisfies the requested operating limits")
    return chosen


def threshold_grid(
    df: DataFrame, keys: Sequence[str], score: str, label: str, caps: Sequence[float | None], costs: Sequence[tuple[float, float]]
) -> DataFrame:
    """``optimize_threshold`` for every (alert cap, cost pair), on one set of running counts."""
    cells = [
        F.struct(F.lit(float(c) if c is not None else 1.0).alias("cap"), F.lit(float(a)).alias("fn_cost"), F.lit(float(b)).alias("fp_cost"))
        for c in caps
        for a, b in costs
    ]
    points = operating_points(df, keys, score, label).withColumn("_g", F.explode(F.array(*cells)))
    priced = _priced(points.select("*", "_g.*").drop("_g"), F.col("fn_cost"), F.col("fp_cost"))
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("rows"))
    legal = priced.where(both & (safe_divide(F.col("alerts"), F.col("rows")) <= F.col("cap")))
    grid = [*keys, "cap", "fn_cost", "fp_cost"]
    return legal.groupBy(*grid).agg(_best(grid)).select(*grid, "b.*")


def apply_threshold(df: DataFrame, score: str, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Alert where the score reaches the key's (possibly transferred) threshold."""
    cut = settle(thresholds.select(*keys, F.col("threshold").alias("_cut")))
    alert = (defined(F.col(score)) & (F.col(score) >= F.col("_cut"))).cast("int")
    return df.join(cut, list(keys)).withColumn("alert", alert).drop("_cut")


def invalid_scores(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Rows, and rows with an undefined score, per key."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(~defined(F.col(score))).alias("invalid"))


def _boundary(df: DataFrame, keys: Sequence[str], score: str, label: str, qs: Sequence[float]) -> DataFrame:
    """The score level in which the review budget ends, per (key, q)."""
    curve = score_curve(df, keys, score, label)
    entries = [F.struct(F.lit(float(q)).alias("q"), review_slots(F.col("total_n"), q).alias("k")) for q in qs]
    asked = curve.withColumn("_q", F.explode(F.array(*entries))).select("*", "_q.q", "_q.k").drop("_q")
    return asked.where((F.col("before_n") < F.col("k")) & (F.col("k") <= F.col("alerts")))


def _with_id_range(df: DataFrame, identity: str) -> DataFrame:
    return with_range(df, identity, value_edges(df, identity), "_id_range")


def capacity_profile(
    df: DataFrame, keys: Sequence[str], score: str, label: str, qs: Sequence[float], identity: str | None = None, fn_cost: float = 100.0
) -> DataFrame:
    """Counts above and inside the boundary tie, with attainable and expected true positives.

    With ``identity`` the tie is also resolved by ascending id (``tp``, ``cost``).
    """
    keys = list(keys)
    b = _boundary(df, keys, score, label, qs)
    r = F.col("k") - F.col("before_n")
    m, f, a = F.col("n"), F.col("pos"), F.col("before_pos")
    profile = b.select(
        *keys,
        "q",
        F.col("total_n").alias("rows"),
        F.col("total_pos").alias("positives"),
        F.col("k").alias("alerts"),
        F.col(score).alias("boundary_score"),
        a.alias("above_tp"),
        m.alias("tie_n"),
        f.alias("tie_positives"),
        r.alias("remaining"),
        (a + F.greatest(F.lit(0), r - (m - f))).alias("tp_min"),
        (a + F.least(r, f)).alias("tp_max"),
        (a + r * f / m).alias("tp_expectation"),
        (r < m).cast("int").alias("split_tie"),
    )
    if identity is None:
        return profile
    profile = settle(profile)
    cut = profile.select(*keys, "q", F.col("boundary_score").alias(score), "remaining")
    members = _with_id_range(df, identity).join(cut, [*keys, score])
    ranked = rank_within(members, [*keys, "q"], [identity], "_id_range")
    caught = ranked.where(F.col("tie_rank") <= F.col("remaining")).groupBy(*keys, "q").agg(
        F.sum(F.col(label).cast("bigint")).alias("_tie_tp")
    )
    tp, p = F.col("tp"), F.col("positives")
    return (
        profile.join(caught, [*keys, "q"], "left")
        .withColumn("tp", F.col("above_tp") + F.coalesce("_tie_tp", F.lit(0)))
        .drop("_tie_tp")
        .withColumns(
            {
                "recall": safe_divide(tp, p),
                "precision": safe_divide(tp, F.col("alerts")),
                "cost": F.col("alerts") - tp + F.lit(float(fn_cost)) * (p - tp),
            }
        )
    )


def fixed_capacity(
    df: DataFrame, keys: Sequence[str], score: str, label: str, identity: str, q: float, ranks: bool = False
) -> DataFrame:
    """Select exactly ceil(qN) rows by score descending, id ascending.

    Only the rows of the boundary tie are ranked, unless full ``score_rank`` is asked for. N counts
    the rows with a defined score; the others come back unselected (and unranked).
    """
    keys = list(keys)
    valid = df.where(defined(F.col(score)))
    if ranks:
        slots = settle(valid.groupBy(*keys).agg(review_slots(F.count("*"), q).alias("_k")))
        out = rank_rows(_with_id_range(valid, identity), keys, score, identity, "_id_range").join(slots, keys)
        out = out.withColumn("selected", (F.col("score_rank") <= F.col("_k")).cast("int")).drop("_k", "_id_range")
        rest = df.where(~defined(F.col(score)))
        return out.unionByName(rest.withColumns({"score_rank": F.lit(None).cast("bigint"), "selected": F.lit(0)}))
    ranged = _with_id_range(df, identity).join(_cut(valid, keys, score, label, q), keys, "left")
    return _resolve(ranged, keys, score, [identity], "_id_range").drop("_id_range")


def _cut(valid: DataFrame, keys, score, label, q) -> DataFrame:
    """Per key the score in which the budget ends, and the rows it still takes there."""
    ends = _boundary(valid, keys, score, label, [q])
    return settle(ends.select(*keys, F.col(score).alias("_cut"), (F.col("k") - F.col("before_n")).alias("_remaining")))


def _resolve(cutted: DataFrame, keys, score, order, order_range) -> DataFrame:
    """Rows above the cut are in; rows at the cut are ranked; the rest is out."""
    above = defined(F.col(score)) & (F.col(score) > F.col("_cut"))
    flat = cutted.where(~F.col(score).eqNullSafe(F.col("_cut")) | F.col("_cut").isNull())
    flat = flat.withColumn("selected", F.coalesce(above, F.lit(False)).cast("int"))
    tie = rank_within(cutted.where(F.col(score) == F.col("_cut")), keys, order, order_range)
    tie = tie.withColumn("selected", (F.col("tie_rank") <= F.col("_remaining")).cast("int")).drop("tie_rank")
    return flat.unionByName(tie).drop("_cut", "_remaining")


def hash_priority_capacity(
    df: DataFrame, keys: Sequence[str], score: str, label: str, identity: str, q: float, prefix: str = "review-order|"
) -> DataFrame:
    """As ``fixed_capacity``, with ties broken by a label-free hash of the id, then the id."""
    keys = list(keys)
    digest = df.withColumn("_digest", hash_priority(prefix, F.col(identity)))
    cut = _cut(df.where(defined(F.col(score))), keys, score, label, q)
    ranged = digest.withColumn("_hash_range", hash_range(F.col("_digest"))).join(cut, keys, "left")
    return _resolve(ranged, keys, score, ["_digest", identity], "_hash_range").drop("_digest", "_hash_range")


def priority_trials(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    label: str,
    identity: str,
    qs: Sequence[float],
    trials: int,
    shared: Sequence[str] = (),
    seed: int = 7,
) -> DataFrame:
    """True positives per trial when the boundary tie is broken by shared random priorities.

    A row's priority depends on the trial, the ``shared`` columns and its id, never on the model,
    so all models meet the same order.

    A trial's last place is found by counts: tied rows are counted by ranges of their hash inside each task,
    so only (key, trial, range) sums are shuffled; the range that the budget ends in is known from their
    running counts, and the rows of that one range, a few in a thousand, are ranked.
    """
    keys = list(keys)
    profile = settle(capacity_profile(df, keys, score, label, qs))
    cut = settle(profile.where(F.col("split_tie") == 1).select(*keys, "q", F.col("boundary_score").alias(score), "remaining"))
    own = F.concat_ws("|", *[F.col(c) for c in shared], F.col(identity))
    digest = lambda trial: F.sha2(F.concat_ws("|", F.lit(seed), trial, F.col("_own")), 256)
    members = df.withColumn("_own", own).join(cut, [*keys, score])
    group = [*keys, "q", "trial"]

    places = F.transform(F.sequence(F.lit(0), F.lit(trials - 1)), lambda t: F.struct(t.alias("trial"), hash_range(digest(t)).alias("_bin")))
    counted = members.select(*keys, "q", "remaining", F.col(label).cast("bigint").alias("_y"), F.explode(places).alias("_t")).select("*", "_t.trial", "_t._bin")
    bins = counted.groupBy(*group, "remaining", "_bin").agg(F.count("*").alias("_n"), F.sum("_y").alias("_p"))
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumns({"_bn": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_bp": F.coalesce(F.sum("_p").over(before), F.lit(0))})
    ends = settle(placed.where((F.col("_bn") < F.col("remaining")) & (F.col("remaining") <= F.col("_bn") + F.col("_n"))))

    edges = ends.groupBy(*keys, "q").agg(F.collect_list(F.struct("trial", "_bin", (F.col("remaining") - F.col("_bn")).alias("room"))).alias("_edges"))
    here = F.filter("_edges", lambda e: hash_range(digest(e["trial"])) == e["_bin"])
    last = members.join(settle(edges), [*keys, "q"]).select(*keys, "q", identity, label, "_own", F.explode(here).alias("_e")).select("*", "_e.trial", "_e.room")
    last = last.withColumn("_digest", digest(F.col("trial"))).withColumn("_next", F.substring("_digest", 4, 3))
    ranked = rank_within(last, group, ["_digest", identity], "_next")
    taken = ranked.where(F.col("tie_rank") <= F.col("room")).groupBy(*group).agg(F.sum(F.col(label).cast("bigint")).alias("_l"))
    caught = ends.join(taken, group, "left").select(*group, (F.col("_bp") + F.coalesce("_l", F.lit(0))).alias("_t"))
    whole = profile.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    tie = F.when(F.col("split_tie") == 1, F.coalesce("_t", F.lit(0))).otherwise(F.col("tie_positives"))
    return whole.join(caught, [*keys, "q", "trial"], "left").select(
        *keys, "q", "trial", "positives", (F.col("above_tp") + tie).alias("tp"), "tp_min", "tp_max"
    )


def bayes_capacity(
    df: DataFrame, keys: Sequence[str], score: str, raw: str, label: str, identity: str, threshold: float, q: float
) -> DataFrame:
    """Fixed threshold, then at most floor(qN) rows by score, raw score and id."""
    if not 0 < threshold < 1 or not 0 < q <= 1:
        raise ValueError("threshold and capacity must lie in (0, 1]")
    keys = list(keys)
    share = Fraction(str(q))
    sizes = settle(
        df.groupBy(*keys).agg(F.count("*").alias("_rows")).withColumn(
            "_limit", F.call_function("div", F.col("_rows") * F.lit(share.numerator), F.lit(share.denominator).cast("bigint"))
        )
    )
    candidates = df.where(defined(F.col(score)) & (F.col(score) >= F.lit(threshold)))
    curve = score_curve(candidates, keys, score, label).join(sizes, keys)
    ends = curve.where((F.col("before_n") < F.col("_limit")) & (F.col("_limit") < F.col("alerts")))
    cut = ends.select(*keys, F.col(score).alias("_cut"), (F.col("_limit") - F.col("before_n")).alias("_room"))
    exact = curve.where(F.col("alerts") <= F.col("_limit")).groupBy(*keys).agg(F.min(score).alias("_low"))
    placed = candidates.join(settle(cut), keys, "left").join(settle(exact), keys, "left")
    tied = placed.where(F.col(score) == F.col("_cut"))
    ranked = rank_rows(_with_id_range(tied, identity), keys, raw, identity, "_id_range", "_rank")
    inside = ranked.where(F.col("_rank") <= F.col("_room")).select(*df.columns)
    above = placed.where((F.col("_low").isNotNull()) & (F.col(score) >= F.col("_low"))).select(*df.columns)
    chosen = above.unionByName(inside).select(*keys, identity, F.lit(1).alias("selected"))
    return df.join(chosen, [*keys, identity], "left").withColumn("selected", F.coalesce("selected", F.lit(0)))


def bayes_summary(df: DataFrame, decided: DataFrame, keys: Sequence[str], score: str, threshold: float) -> DataFrame:
    """Candidate and final alert counts and whether the capacity bound."""
    return decided.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_if(defined(F.col(score)) & (F.col(score) >= F.lit(threshold))).alias("candidates"),
        F.sum(F.col("selected").cast("bigint")).alias("alerts"),
    ).withColumns(
        {
            "binding": (F.col("alerts") < F.col("candidates")).cast("int"),
            "final_alert_rate": safe_divide(F.col("alerts"), F.col("rows")),
        }
    )
