"""Exact ranking and decision metrics.

Rows are summed into (key, score) levels first; everything else reads the running counts of those
levels, so no window ever holds the rows of a whole population.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.prefix import running, value_edges, with_range
from riskframe.functions.scalars import CLIP, checked_score, safe_divide

# Fixed value: machine epsilon, the clip of the log loss.
EPS = 2.220446049250313e-16


#: In place of a label: the table holds score levels already, rows in ``n`` and positives in ``pos``.
LEVELS = "@levels"


def score_levels(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Rows and positives per (key, score). An undefined score is an error."""
    if label == LEVELS:
        return df.groupBy(*keys, score).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return df.withColumn(score, checked_score(F.col(score))).groupBy(*keys, score).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )


def score_curve(df: DataFrame, keys: Sequence[str], score: str, label: str, ranges: int | None = None) -> DataFrame:
    """Levels with what an alert at or above them would catch.

    Columns: keys, score, n, pos, before_n, before_pos (strictly higher scores), total_n,
    total_pos, alerts, tp.
    """
    edges = value_edges(df, score, ranges)
    levels = with_range(score_levels(df, keys, score, label), score, edges, "_range")
    curve = running(levels, keys, score, "_range", sums=["n", "pos"], descending=True, totals=True)
    return curve.drop("_range").withColumns(
        {"alerts": F.col("before_n") + F.col("n"), "tp": F.col("before_pos") + F.col("pos")}
    )


def curve_ap() -> Column:
    """Step-rule average precision over score levels; null without positives."""
    gain = safe_divide(F.col("pos"), F.col("total_pos")) * safe_divide(F.col("tp"), F.col("alerts"))
    return F.sum(gain)


def curve_auc() -> Column:
    """Tie-corrected area under the ROC curve; null unless both classes occur."""
    neg = F.col("n") - F.col("pos")
    total_neg = F.col("total_n") - F.col("total_pos")
    below = total_neg - (F.col("before_n") - F.col("before_pos")) - neg
    wins = F.sum(F.col("pos").cast("double") * (below + neg / F.lit(2.0)))
    pairs = F.max(F.col("total_pos").cast("double") * total_neg)
    return F.when(pairs > 0, F.try_divide(wins, pairs))


def ranking_metrics(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    return score_curve(df, keys, score, label).groupBy(*keys).agg(
        curve_ap().alias("pr_auc"), curve_auc().alias("roc_auc")
    )


def average_precision(df, keys, score, label):
    return score_curve(df, keys, score, label).groupBy(*keys).agg(curve_ap().alias("ap"))


def roc_auc(df, keys, score, label):
    return score_curve(df, keys, score, label).groupBy(*keys).agg(curve_auc().alias("roc_auc"))


def _cell(label: Column, decision: Column, y: int, d: int) -> Column:
    return F.coalesce(F.sum(((label == y) & (decision == d)).cast("bigint")), F.lit(0))


def confusion(df: DataFrame, keys: Sequence[str], label: str, decision: Column) -> DataFrame:
    y, d = F.col(label), decision.cast("int")
    return df.groupBy(*keys).agg(
        _cell(y, d, 0, 0).alias("tn"), _cell(y, d, 0, 1).alias("fp"), _cell(y, d, 1, 0).alias("fn"), _cell(y, d, 1, 1).alias("tp")
    )


#: What ``rates`` returns.
RATE_NAMES = (
    "accuracy", "balanced_accuracy", "precision", "recall", "specificity", "false_positive_rate", "alert_rate",
    "prevalence", "f1", "mcc", "business_cost", "cost_per_1000",
)


def rates(fn_cost: float = 10.0, fp_cost: float = 1.0) -> dict[str, Column]:
    """Every rate of a confusion table; a zero denominator gives zero."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    zero = lambda a, b: F.coalesce(safe_divide(a, b), F.lit(0.0))
    recall, specificity, precision = zero(tp, tp + fn), zero(tn, tn + fp), zero(tp, tp + fp)
    scale = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    cost = F.lit(float(fn_cost)) * fn + F.lit(float(fp_cost)) * fp
    return {
        "accuracy": zero(tn + tp, total),
        "balanced_accuracy": (recall + specificity) / 2,
        "precision": precision,
        "recall": recall,
        "specificity": specificity,
        "false_positive_rate": F.lit(1.0) - specificity,
        "alert_rate": zero(tp + fp, total),
        "prevalence": zero(tp + fn, total),
        "f1": zero(2 * tp, 2 * tp + fp + fn),
        "mcc": zero(tp.cast("double") * tn - fp.cast("double") * fn, scale),
        "business_cost": cost,
        "cost_per_1000": zero(cost * 1000, total),
    }


def evaluate(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    label: str,
    threshold: float | Column = 0.5,
    fn_cost: float = 10.0,
    fp_cost: float = 1.0,
    ranking: bool = True,
) -> DataFrame:
    """Full report at one threshold per key: confusion, rates, cost, AP, ROC area, Brier, ECE."""
    from riskframe.operators.calibration import ece, probability_metrics

    keys = list(keys)
    if ranking and not keys:
        raise ValueError("a report with ranking metrics needs at least one key column")
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    out = confusion(df, keys, label, F.col(score) >= cut).withColumns(rates(fn_cost, fp_cost))
    if not ranking:
        return out
    extra = ranking_metrics(df, keys, score, label)
    probability = probability_metrics(df, keys, score, label, ap=False).drop("log_loss")
    error = ece(df, keys, score, label, "uniform", 10).select(*keys, "ece")
    for part in (extra, probability, error):
        out = out.join(part, keys)
    return out


def decision_metrics(df: DataFrame, keys: Sequence[str], label: str, decision: str, fn_cost: float, fp_cost: float) -> DataFrame:
    """Metrics and cost fields of a given decision column."""
    table = confusion(df, keys, label, F.col(decision))
    report = rates(fn_cost, fp_cost)
    kept = {k: report[k] for k in ("precision", "recall", "f1", "alert_rate")}
    return table.withColumns(kept).withColumns(cost_fields(fn_cost, fp_cost))


def cost_fields(fn_cost: float, fp_cost: float) -> dict[str, Column]:
    fn_part = F.col("fn") * F.lit(float(fn_cost))
    fp_part = F.col("fp") * F.lit(float(fp_cost))
    normal = (F.col("tp") + F.col("fn")) * F.lit(float(fn_cost))
    return {
        "false_negative_cost": fn_part,
        "false_positive_cost": fp_part,
        "business_cost": fn_part + fp_part,
        "all_normal_cost": normal,
        "cost_saving": normal - fn_part - fp_part,
        "cost_saving_rate": safe_divide(normal - fn_part - fp_part, normal),
    }


def cost_saving(report: DataFrame, fn_cost: float, fp_cost: float, capacity: float) -> DataFrame:
    """Cost decomposition, capacity drift, and whether the confusion identities hold."""
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    alerts = F.col("tp") + F.col("fp")
    rate = safe_divide(alerts, total)
    fields = cost_fields(fn_cost, fp_cost)
    ok = F.lit(True)
    if "business_cost" in report.columns:
        ok = ok & (F.abs(F.col("business_cost") - fields["business_cost"]) <= 1e-9)
    if "alert_rate" in report.columns:
        ok = ok & (F.abs(F.col("alert_rate") - rate) <= 1e-12)
    return report.withColumn("identities_ok", ok).withColumns(
        {
            **fields,
            "alert_count": alerts,
            "capacity_deviation": rate - F.lit(capacity),
            "capacity_deviation_abs": F.abs(rate - F.lit(capacity)),
            "rows": total,
            "positives": F.col("tp") + F.col("fn"),
        }
    )


def deployment_metrics(
    df: DataFrame, keys: Sequence[str], score: str, label: str, cents: str, threshold: float, fn_cost: float, fp_cost: float
) -> DataFrame:
    """Amount captured and missed, errors per 10,000 rows, and lift over the base rate."""
    keys = list(keys)
    hit, y = F.col(score) >= F.lit(threshold), F.col(label)
    money = df.groupBy(*keys).agg(
        F.sum(F.when(y == 1, F.col(cents))).alias("_all"), F.sum(F.when((y == 1) & hit, F.col(cents)).otherwise(0)).alias("_got")
    )
    table = confusion(df, keys, label, hit).withColumns(rates(fn_cost, fp_cost))
    joined = table.join(money, keys).join(average_precision(df, keys, score, label), keys)
    rows = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return joined.withColumns(cost_fields(fn_cost, fp_cost)).select(
        *keys,
        (F.lit(1.0) - F.col("prevalence")).alias("majority_accuracy"),
        (F.col("accuracy") - (F.lit(1.0) - F.col("prevalence"))).alias("accuracy_delta"),
        safe_divide(F.col("ap"), F.col("prevalence")).alias("ap_lift"),
        (F.col("fp") * F.lit(10000.0) / rows).alias("fp_per_10000"),
        (F.col("fn") * F.lit(10000.0) / rows).alias("fn_per_10000"),
        F.coalesce(safe_divide(F.col("_got"), F.col("_all")), F.lit(0.0)).alias("amount_recall"),
        ((F.coalesce("_all", F.lit(0)) - F.col("_got")) / F.lit(100.0)).alias("missed_amount"),
        (F.col("business_cost") * F.lit(10000.0) / rows).alias("cost_per_10000"),
        "all_normal_cost",
        "cost_saving",
        F.coalesce("cost_saving_rate", F.lit(0.0)).alias("cost_saving_rate"),
    )


def stage_metrics(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """AP, distinct scores, tied rows and saturation at both clipping bounds."""
    curve = score_curve(df, keys, score, label)
    tied = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    return curve.groupBy(*keys).agg(
        curve_ap().alias("ap"),
        F.count("*").alias("unique_scores"),
        tied.cast("bigint").alias("tied_rows"),
        F.sum(F.when(F.col(score) <= CLIP, F.col("n")).otherwise(0)).cast("bigint").alias("low_saturated"),
        F.sum(F.when(F.col(score) >= 1 - CLIP, F.col("n")).otherwise(0)).cast("bigint").alias("high_saturated"),
    )


def melt_stages(df: DataFrame, stages: Sequence[str] = ("raw", "clipped", "platt")) -> DataFrame:
    """Long form (stage, score) of the stage columns."""
    keep = [c for c in df.columns if c not in stages]
    entries = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("score")) for s in stages])
    return df.withColumn("_s", F.explode(entries)).select(*keep, "_s.stage", "_s.score")


def ledger_metrics(df: DataFrame, keys: Sequence[str], score: str, label: str, identity: str, q: float = 0.03, fn_cost: float = 100.0) -> DataFrame:
    """Every test metric of a prediction ledger, recomputed per key."""
    from riskframe.operators.decisions import capacity_profile

    keys = list(keys)
    profile = capacity_profile(df, keys, score, label, [q], identity)
    tp, k, p, n = (F.col(c) for c in ("tp", "alerts", "positives", "rows"))
    decided = profile.select(
        *keys,
        n,
        p,
        k,
        tp,
        (k - tp).alias("fp"),
        (p - tp).alias("fn"),
        (n - k - p + tp).alias("tn"),
        safe_divide(tp, k).alias("precision"),
        F.coalesce(safe_divide(tp, p), F.lit(0.0)).alias("recall"),
        F.coalesce(safe_divide(2 * tp, k + p), F.lit(0.0)).alias("f1"),
        safe_divide(k, n).alias("alert_rate"),
        (safe_divide(k, n) - F.lit(q)).alias("capacity_deviation"),
        (k - tp + F.lit(float(fn_cost)) * (p - tp)).alias("business_cost"),
        (F.lit(float(fn_cost)) * p).alias("baseline_cost"),
    ).withColumn("cost_saving_rate", F.coalesce(safe_divide(F.col("baseline_cost") - F.col("business_cost"), F.col("baseline_cost")), F.lit(0.0)))
    return decided.join(ranking_metrics(df, keys, score, label), keys)


def step_attribution(selected: DataFrame, keys: Sequence[str], time: str, label: str, decision: str) -> DataFrame:
    """Captured positives per time from a selection made over the whole window, zeros included."""
    return selected.groupBy(*keys, time).agg(
        F.count("*").alias("rows"), F.sum((F.col(label) * F.col(decision)).cast("bigint")).alias("captured")
    )


def ranking_record(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """AP, ROC area, Brier and ECE per key (for instance per split and model)."""
    from riskframe.operators.calibration import ece, probability_metrics

    keys = list(keys)
    return (
        ranking_metrics(df, keys, score, label)
        .join(probability_metrics(df, keys, score, label, ap=False).drop("log_loss"), keys)
        .join(ece(df, keys, score, label, "uniform", 10).select(*keys, "ece"), keys)
    )
