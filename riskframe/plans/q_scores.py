"""Queries over scored ledgers: decisions (D), metrics (E) and calibration (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import scalars as X
from riskframe.functions.prefix import settle
from riskframe.operators import calibration as C
from riskframe.operators import decisions as D
from riskframe.operators import metrics as M
from riskframe.operators.splits import calibration_threshold_boundaries
from riskframe.plans.canon import LEDGER, LEDGER_BOTH, LEDGER_VALIDATION, MODELS, SEEDS, SHOP, TX, ledger, shop, stored, tx
from riskframe.plans.registry import query

K = ["fold", "seed", "model"]
KS = "fold, seed, model"


def rounded(df, digits=6):
    """Round every double column; scores keep nine digits."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.round(F.col(c), digits) for c, t in kinds.items() if t == "double"})


def curve_sql(score="raw", source="ledger", name="cv", keys=KS):
    return f"""{name}_l AS (SELECT {keys}, {score} AS s, count(*) AS n, sum(label)::BIGINT AS pos FROM {source} GROUP BY ALL),
{name} AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY s DESC)::BIGINT AS alerts,
    sum(pos) OVER (PARTITION BY {keys} ORDER BY s DESC)::BIGINT AS tp,
    sum(n) OVER (PARTITION BY {keys})::BIGINT AS rows, sum(pos) OVER (PARTITION BY {keys})::BIGINT AS positives FROM {name}_l)"""


AP = "sum(pos::DOUBLE / positives * (tp::DOUBLE / alerts))"
AUC = """sum(pos::DOUBLE * ((rows - positives) - (alerts - tp) + (n - pos) / 2::DOUBLE))
  / max(positives::DOUBLE * (rows - positives))"""


def slots(q):
    num, den = {0.01: (1, 100), 0.03: (3, 100), 0.05: (1, 20)}[q]
    return f"((rows * {num} + {den - 1}) // {den})"


def points_sql(score="raw", source="ledger", name="pt"):
    return f"""{curve_sql(score, source, name + '_c')},
{name} AS (SELECT {KS}, s AS threshold, alerts, tp, rows, positives, positives - tp AS fn, alerts - tp AS fp FROM {name}_c
  UNION ALL SELECT {KS}, greatest(max(s) * (1 + 2.220446049250313e-16::DOUBLE), 5e-324), 0, 0, max(rows), max(positives),
    max(positives), 0 FROM {name}_c GROUP BY {KS})"""


PICK = "row_number() OVER (PARTITION BY {keys} ORDER BY {cost}, tp DESC, alerts, threshold DESC) = 1"


def best_sql(name, points, cost, where, keys=KS):
    return f"""{name} AS (SELECT *, {cost} AS cost FROM {points} WHERE {where}
  QUALIFY {PICK.format(keys=keys, cost=cost)})"""


# ---- decisions ---------------------------------------------------------------------------------


@query(
    "d01_optimize_threshold",
    f"""WITH {LEDGER}, {points_sql()},
{best_sql('b', 'pt', '(100::DOUBLE * fn + 1::DOUBLE * fp)', 'alerts::DOUBLE / rows <= 0.1 AND fn::DOUBLE / positives <= 0.98')}
SELECT {KS}, round(threshold, 9) AS threshold, cost, tp, fp, fn, alerts, rows, positives FROM b""",
)
def _(spark, d):
    out = D.optimize_threshold(ledger(spark, d), K, "raw", "label", 100, 1, max_alert_rate=0.1, max_fnr=0.98)
    return rounded(out, 9)


@query(
    "d02_threshold_grid",
    f"""WITH {LEDGER}, {points_sql()}, gr AS (SELECT * FROM pt,
  (VALUES (0.01::DOUBLE), (0.03::DOUBLE), (0.05::DOUBLE), (1.0::DOUBLE)) c(cap), (VALUES (10::DOUBLE), (100::DOUBLE)) f(fn_cost)
  WHERE alerts::DOUBLE / rows <= cap)
SELECT {KS}, cap, fn_cost, 1::DOUBLE AS fp_cost, round(threshold, 9) AS threshold, fn_cost * fn + fp AS cost, tp, fp, fn, alerts, rows, positives
FROM gr QUALIFY {PICK.format(keys=KS + ', cap, fn_cost', cost='fn_cost * fn + fp')}""",
)
def _(spark, d):
    return rounded(D.threshold_grid(ledger(spark, d), K, "raw", "label", [0.01, 0.03, 0.05, None], [(10, 1), (100, 1)]), 9)


@query(
    "d03_apply_threshold",
    f"""WITH {LEDGER_BOTH}, {points_sql('raw', 'led_validation')},
{best_sql('b', 'pt', '(100::DOUBLE * fn + 1::DOUBLE * fp)', 'alerts::DOUBLE / rows <= 0.03')}
SELECT l.fold, l.seed, l.model, id, CAST(raw >= threshold AS INTEGER) AS alert FROM ledger l JOIN b USING ({KS})""",
)
def _(spark, d):
    cut = D.optimize_threshold(ledger(spark, d, "validation"), K, "raw", "label", 100, 1, max_alert_rate=0.03)
    return D.apply_threshold(ledger(spark, d), "raw", cut, K).select(*K, "id", "alert")


RANKED = f"""rk AS (SELECT *, count(*) OVER (PARTITION BY {KS}) AS rows,
    row_number() OVER (PARTITION BY {KS} ORDER BY raw DESC, id) AS score_rank FROM ledger)"""


@query(
    "d04_fixed_capacity",
    f"WITH {LEDGER}, {RANKED} SELECT {KS}, id, CAST(score_rank <= {slots(0.03)} AS INTEGER) AS selected FROM rk",
)
def _(spark, d):
    return D.fixed_capacity(ledger(spark, d), K, "raw", "label", "id", 0.03).select(*K, "id", "selected")


@query(
    "d04_full_ranks",
    f"WITH {LEDGER}, {RANKED} SELECT {KS}, id, score_rank, CAST(score_rank <= {slots(0.03)} AS INTEGER) AS selected FROM rk",
)
def _(spark, d):
    return D.fixed_capacity(ledger(spark, d), K, "raw", "label", "id", 0.03, ranks=True).select(*K, "id", "score_rank", "selected")


# A ledger in which some scores are missing and some are NaN, by a rule on the id.
GAPS = """gaps AS (SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN 'nan'::DOUBLE ELSE raw END AS raw) FROM ledger)"""
WHOLE = "raw IS NOT NULL AND NOT isnan(raw)"


def _gaps(spark, d):
    raw = F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("raw"))
    return ledger(spark, d).withColumn("raw", raw)


@query(
    "d04_invalid_scores",
    f"""WITH {LEDGER}, {GAPS}, rk AS (SELECT *, row_number() OVER (PARTITION BY {KS} ORDER BY raw DESC, id) AS score_rank, count(*) OVER (PARTITION BY {KS}) AS n FROM gaps WHERE {WHOLE})
SELECT {KS}, id, CAST(coalesce(score_rank <= {slots(0.03).replace("rows", "n")}, false) AS INTEGER) AS selected, count(*) OVER (PARTITION BY {KS}) AS rows, count(*) FILTER (NOT coalesce({WHOLE.replace("raw", "g.raw")}, false)) OVER (PARTITION BY {KS}) AS invalid
FROM gaps g LEFT JOIN (SELECT {KS}, id, score_rank, n FROM rk) USING ({KS}, id)""",
)
def _(spark, d):
    rows = _gaps(spark, d)
    counts = D.invalid_scores(rows, K, "raw")
    return D.fixed_capacity(rows, K, "raw", "label", "id", 0.03).select(*K, "id", "selected").join(counts, K)


@query(
    "d07_invalid_scores",
    f"""WITH {LEDGER}, {GAPS}, rk AS (SELECT {KS}, id, row_number() OVER (PARTITION BY {KS} ORDER BY raw DESC, sha256('review-order|' || id), id) AS score_rank, count(*) OVER (PARTITION BY {KS}) AS n FROM gaps WHERE {WHOLE})
SELECT {KS}, id, CAST(coalesce(score_rank <= {slots(0.03).replace("rows", "n")}, false) AS INTEGER) AS selected FROM gaps LEFT JOIN rk USING ({KS}, id)""",
)
def _(spark, d):
    return D.hash_priority_capacity(_gaps(spark, d), K, "raw", "label", "id", 0.03).select(*K, "id", "selected")


def profile_sql(score="raw", qs=(0.01, 0.03, 0.05), keys=KS, source="ledger", name="pf"):
    grid = ", ".join(f"({q}::DOUBLE, {slots(q).split('*')[1].split('+')[0].strip()}, {slots(q).split('//')[1].strip(') ')})" for q in qs)
    return f"""{curve_sql(score, source, name + '_c', keys)}, {name}_q(q, num, den) AS (VALUES {grid}),
{name}_b AS (SELECT {keys}, q, rows, positives, (rows * num + den - 1) // den AS k, s, tp - pos AS above_tp, n AS tie_n,
    pos AS tie_positives, (rows * num + den - 1) // den - (alerts - n) AS remaining
  FROM {name}_c, {name}_q WHERE alerts - n < (rows * num + den - 1) // den AND (rows * num + den - 1) // den <= alerts),
{name}_t AS (SELECT b.*, l.label, row_number() OVER (PARTITION BY {", ".join("b." + k.strip() for k in keys.split(","))}, q ORDER BY id) AS tr
  FROM {name}_b b JOIN {source} l ON {" AND ".join(f"b.{k.strip()} = l.{k.strip()}" for k in keys.split(","))} AND l.{score} = b.s),
{name} AS (SELECT {keys}, q, any_value(rows) AS rows, any_value(positives) AS positives, any_value(k) AS alerts, s AS boundary_score,
    any_value(above_tp) AS above_tp, any_value(tie_n) AS tie_n, any_value(tie_positives) AS tie_positives,
    any_value(remaining) AS remaining,
    any_value(above_tp + greatest(0, remaining - (tie_n - tie_positives))) AS tp_min,
    any_value(above_tp + least(remaining, tie_positives)) AS tp_max,
    any_value(above_tp + remaining * tie_positives / tie_n::DOUBLE) AS tp_expectation,
    any_value(CAST(remaining < tie_n AS INTEGER)) AS split_tie,
    (any_value(above_tp) + count(*) FILTER (label = 1 AND tr <= remaining))::BIGINT AS tp
  FROM {name}_t GROUP BY {keys}, q, s)"""


@query(
    "d05_capacity_profile",
    f"""WITH {LEDGER}, {profile_sql()}
SELECT * REPLACE (round(tp_expectation, 6) AS tp_expectation), round(tp::DOUBLE / positives, 6) AS recall,
  round(tp::DOUBLE / alerts, 6) AS precision, (alerts - tp + 100 * (positives - tp))::DOUBLE AS cost FROM pf""",
)
def _(spark, d):
    return rounded(D.capacity_profile(ledger(spark, d), K, "raw", "label", [0.01, 0.03, 0.05], "id"))


BAYES = f"""rk AS (SELECT *, count(*) OVER (PARTITION BY {KS}) AS rows,
    count(*) FILTER (ps >= 0.3) OVER (PARTITION BY {KS}) AS cands,
    row_number() OVER (PARTITION BY {KS} ORDER BY ps DESC, raw DESC, id) AS r
  FROM (SELECT *, round(raw, 1) AS ps FROM ledger)),
dc AS (SELECT *, CAST(ps >= 0.3 AND r <= greatest(rows // 20, 0) AS INTEGER) AS selected FROM rk)"""


def _coarse(df):
    """A merged score with large ties, as a step-shaped calibration map would give."""
    return df.withColumn("ps", F.round(F.col("raw"), 1))


@query(
    "d06_bayes_capacity",
    f"WITH {LEDGER}, {BAYES} SELECT {KS}, id, selected FROM dc",
)
def _(spark, d):
    out = D.bayes_capacity(_coarse(ledger(spark, d)), K, "ps", "raw", "label", "id", 0.3, 0.05)
    return out.select(*K, "id", "selected")


@query(
    "d06_bayes_branch",
    f"""WITH {LEDGER}, {BAYES}, c AS (SELECT {KS}, count(*) AS rows, count(*) FILTER (ps >= 0.3) AS candidates,
    sum(selected)::BIGINT AS alerts, count(*) FILTER (label = 0 AND selected = 0) AS tn, count(*) FILTER (label = 0 AND selected = 1) AS fp,
    count(*) FILTER (label = 1 AND selected = 0) AS fn, count(*) FILTER (label = 1 AND selected = 1) AS tp FROM dc GROUP BY {KS})
SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, CAST(alerts < candidates AS INTEGER) AS binding,
  round(alerts::DOUBLE / rows, 6) AS final_alert_rate, fn * 100::DOUBLE AS false_negative_cost, fp * 1::DOUBLE AS false_positive_cost,
  fn * 100::DOUBLE + fp AS business_cost, (tp + fn) * 100::DOUBLE AS all_normal_cost,
  (tp + fn) * 100::DOUBLE - fn * 100 - fp AS cost_saving,
  round(((tp + fn) * 100::DOUBLE - fn * 100 - fp) / nullif((tp + fn) * 100::DOUBLE, 0), 6) AS cost_saving_rate FROM c""",
)
def _(spark, d):
    return rounded(C.bayes_branch(_coarse(ledger(spark, d)), K, "ps", "raw", "label", "id", 0.3, 0.05, 100, 1))


@query(
    "d07_hash_priority_capacity",
    f"""WITH {LEDGER}, rk AS (SELECT *, count(*) OVER (PARTITION BY {KS}) AS rows, row_number() OVER (PARTITION BY {KS}
    ORDER BY round(raw, 1) DESC, sha256('review-order|' || id), id) AS r FROM ledger)
SELECT {KS}, id, CAST(r <= {slots(0.03)} AS INTEGER) AS selected FROM rk""",
)
def _(spark, d):
    return D.hash_priority_capacity(_coarse(ledger(spark, d)), K, "ps", "label", "id", 0.03).select(*K, "id", "selected")


@query(
    "d08_priority_trials",
    f"""WITH {LEDGER}, coarse AS (SELECT *, round(raw, 1) AS ps FROM ledger), {profile_sql('ps', (0.03, 0.05), KS, 'coarse')},
m AS (SELECT p.*, trial, label, row_number() OVER (PARTITION BY p.fold, p.seed, p.model, q, trial
    ORDER BY sha256(concat_ws('|', 7, trial, p.fold, id)), id) AS r
  FROM pf p JOIN coarse l ON l.fold = p.fold AND l.seed = p.seed AND l.model = p.model AND l.ps = p.boundary_score,
  (SELECT unnest(range(20)) AS trial))
SELECT {KS}, q, CAST(trial AS INTEGER) AS trial, any_value(positives) AS positives, any_value(tp_min) AS tp_min, any_value(tp_max) AS tp_max,
  (any_value(above_tp) + count(*) FILTER (label = 1 AND r <= remaining))::BIGINT AS tp FROM m GROUP BY {KS}, q, trial""",
)
def _(spark, d):
    return D.priority_trials(_coarse(ledger(spark, d)), K, "ps", "label", "id", [0.03, 0.05], 20, ["fold"])


# ---- metrics -----------------------------------------------------------------------------------


def confusion_sql(name="cf", source="ledger", alert="raw >= 0.5", keys=KS):
    return f"""{name} AS (SELECT {keys}, count(*) FILTER (label = 0 AND NOT ({alert})) AS tn, count(*) FILTER (label = 0 AND {alert}) AS fp,
    count(*) FILTER (label = 1 AND NOT ({alert})) AS fn, count(*) FILTER (label = 1 AND {alert}) AS tp FROM {source} GROUP BY {keys})"""


def z(a, b):
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"


def rates_sql(fn_cost=10, fp_cost=1):
    recall, spec = z("tp", "tp + fn"), z("tn", "tn + fp")
    total = "(tn + fp + fn + tp)"
    cost = f"({fn_cost}::DOUBLE * fn + {fp_cost}::DOUBLE * fp)"
    return {
        "accuracy": z("tn + tp", total),
        "balanced_accuracy": f"({recall} + {spec}) / 2",
        "precision": z("tp", "tp + fp"),
        "recall": recall,
        "specificity": spec,
        "false_positive_rate": f"1 - {spec}",
        "alert_rate": z("tp + fp", total),
        "prevalence": z("tp + fn", total),
        "f1": z("2 * tp", "2 * tp + fp + fn"),
        "mcc": z("tp::DOUBLE * tn - fp::DOUBLE * fn", "sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))"),
        "business_cost": cost,
        "cost_per_1000": z(f"{cost} * 1000", total),
    }


def listed(columns, digits=6):
    return ", ".join(f"round({v}, {digits}) AS {k}" for k, v in columns.items())


EDGES10 = [i * 0.1 for i in range(10)] + [1.0]


def bins_sql(score, source, name="bn", keys=KS):
    index = " + ".join(f"CAST(p >= {e!r}::DOUBLE AS INTEGER)" for e in EDGES10[1:-1])
    return f"""{name}_p AS (SELECT {keys}, label, greatest(0, least(1, {score})) AS p FROM {source}),
{name}_s AS (SELECT {keys}, {index} AS bin_id, count(*) AS sample_count, sum(label)::BIGINT AS positive_count, avg(p) AS mean_predicted,
    avg(label) AS observed_rate FROM {name}_p GROUP BY ALL),
{name}_e AS (SELECT {keys}, sum(sample_count * abs(observed_rate - mean_predicted)) / sum(sample_count) AS ece, count(*) AS filled_bins,
    10 - count(*) AS empty_bins, max(sample_count)::DOUBLE / sum(sample_count) AS largest_share, min(sample_count) AS smallest_bin,
    max(sample_count) AS largest_bin FROM {name}_s GROUP BY {keys})"""


BRIER = "avg((p - label) * (p - label))"
LOGLOSS = """avg(-(label * ln(greatest(2.220446049250313e-16::DOUBLE, least(1 - 2.220446049250313e-16::DOUBLE, p)))
  + (1 - label) * ln(1 - greatest(2.220446049250313e-16::DOUBLE, least(1 - 2.220446049250313e-16::DOUBLE, p)))))"""


@query(
    "e01_evaluate",
    f"""WITH {LEDGER}, {confusion_sql()}, {curve_sql()}, {bins_sql('raw', 'ledger')},
r AS (SELECT {KS}, {AP} AS pr_auc, {AUC} AS roc_auc FROM cv GROUP BY {KS}), b AS (SELECT {KS}, {BRIER} AS brier FROM bn_p GROUP BY {KS})
SELECT {KS}, tn, fp, fn, tp, {listed(rates_sql())}, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc,
  round(brier, 6) AS brier, round(ece, 6) AS ece FROM cf JOIN r USING ({KS}) JOIN b USING ({KS}) JOIN bn_e USING ({KS})""",
)
def _(spark, d):
    return rounded(M.evaluate(ledger(spark, d), K, "raw", "label"))


@query("e02_roc_auc", f"WITH {LEDGER}, {curve_sql()} SELECT {KS}, round({AUC}, 9) AS roc_auc FROM cv GROUP BY {KS}")
def _(spark, d):
    return rounded(M.roc_auc(ledger(spark, d), K, "raw", "label"), 9)


@query("e03_average_precision", f"WITH {LEDGER}, {curve_sql()} SELECT {KS}, round({AP}, 9) AS ap FROM cv GROUP BY {KS}")
def _(spark, d):
    return rounded(M.average_precision(ledger(spark, d), K, "raw", "label"), 9)


COSTS = {
    "false_negative_cost": "fn * 100::DOUBLE",
    "false_positive_cost": "fp * 1::DOUBLE",
    "business_cost": "fn * 100::DOUBLE + fp",
    "all_normal_cost": "(tp + fn) * 100::DOUBLE",
    "cost_saving": "(tp + fn) * 100::DOUBLE - fn * 100::DOUBLE - fp",
    "cost_saving_rate": "((tp + fn) * 100::DOUBLE - fn * 100::DOUBLE - fp) / nullif((tp + fn) * 100::DOUBLE, 0)",
}


@query(
    "e04_decision_metrics",
    f"""WITH {LEDGER}, {confusion_sql()}
SELECT {KS}, tn, fp, fn, tp, {listed({k: v for k, v in rates_sql(100).items() if k in ('precision', 'recall', 'f1', 'alert_rate')})},
  {listed(COSTS)} FROM cf""",
)
def _(spark, d):
    rows = ledger(spark, d).withColumn("alert", (F.col("raw") >= 0.5).cast("int"))
    return rounded(M.decision_metrics(rows, K, "label", "alert", 100, 1))


@query(
    "e05_cost_saving",
    f"""WITH {LEDGER}, {confusion_sql()}
SELECT {KS}, tn, fp, fn, tp, {listed({k: v for k, v in rates_sql(100).items() if k != 'business_cost'})}, {listed(COSTS)}, true AS identities_ok,
  tp + fp AS alert_count, round((tp + fp)::DOUBLE / (tp + fp + tn + fn) - 0.03, 6) AS capacity_deviation,
  round(abs((tp + fp)::DOUBLE / (tp + fp + tn + fn) - 0.03), 6) AS capacity_deviation_abs, tp + fp + tn + fn AS rows, tp + fn AS positives FROM cf""",
)
def _(spark, d):
    report = M.evaluate(ledger(spark, d), K, "raw", "label", 0.5, 100, 1, ranking=False)
    return rounded(M.cost_saving(report, 100, 1, 0.03))


@query(
    "e06_deployment_metrics",
    f"""WITH {LEDGER}, {confusion_sql()}, {curve_sql()}, r AS (SELECT {KS}, {AP} AS ap FROM cv GROUP BY {KS}),
a AS (SELECT {KS}, sum(amount_cents) FILTER (label = 1) AS al, coalesce(sum(amount_cents) FILTER (label = 1 AND raw >= 0.5), 0) AS got
  FROM ledger GROUP BY {KS}), j AS (SELECT *, tp + fp + tn + fn AS rows FROM cf JOIN r USING ({KS}) JOIN a USING ({KS}))
SELECT {KS}, round(1 - (tp + fn)::DOUBLE / rows, 6) AS majority_accuracy,
  round((tn + tp)::DOUBLE / rows - (1 - (tp + fn)::DOUBLE / rows), 6) AS accuracy_delta, round(ap / ((tp + fn)::DOUBLE / rows), 6) AS ap_lift,
  round(fp * 10000::DOUBLE / rows, 6) AS fp_per_10000, round(fn * 10000::DOUBLE / rows, 6) AS fn_per_10000,
  round(coalesce(got::DOUBLE / al, 0), 6) AS amount_recall, round((al - got) / 100::DOUBLE, 6) AS missed_amount,
  round((fn * 10::DOUBLE + fp) * 10000 / rows, 6) AS cost_per_10000, (tp + fn) * 10::DOUBLE AS all_normal_cost,
  (tp + fn) * 10::DOUBLE - fn * 10 - fp AS cost_saving,
  round(coalesce(((tp + fn) * 10::DOUBLE - fn * 10 - fp) / nullif((tp + fn) * 10::DOUBLE, 0), 0), 6) AS cost_saving_rate FROM j""",
)
def _(spark, d):
    return rounded(M.deployment_metrics(ledger(spark, d), K, "raw", "label", "amount_cents", 0.5, 10, 1))


STAGES = """st AS (SELECT fold, seed, model, id, time, label, 'raw' AS stage, raw AS score FROM ledger
  UNION ALL SELECT fold, seed, model, id, time, label, 'clipped', clipped FROM ledger
  UNION ALL SELECT fold, seed, model, id, time, label, 'platt', platt FROM ledger)"""


@query(
    "e07_stage_metrics",
    f"""WITH {LEDGER}, {STAGES}, {curve_sql('score', 'st', 'cv', KS + ', stage')}
SELECT {KS}, stage, round({AP}, 9) AS ap, count(*) AS unique_scores, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS tied_rows,
  coalesce(sum(n) FILTER (s <= 1e-6), 0)::BIGINT AS low_saturated, coalesce(sum(n) FILTER (s >= 1 - 1e-6::DOUBLE), 0)::BIGINT AS high_saturated
FROM cv GROUP BY {KS}, stage""",
)
def _(spark, d):
    return rounded(M.stage_metrics(M.melt_stages(ledger(spark, d)), [*K, "stage"], "score", "label"), 9)


def ledger_metrics_sql(source="ledger", p=""):
    """CTEs ending in ``{p}lm``: one row of test metrics per (fold, seed, model)."""
    return f"""{profile_sql('raw', (0.03,), KS, source, p + 'pf')}, {curve_sql('raw', source, p + 'cv')}, {p}rr AS (SELECT {KS}, {AP} AS pr_auc, {AUC} AS roc_auc FROM {p}cv GROUP BY {KS}),
{p}lm AS (SELECT {KS}, rows, positives, alerts, tp, alerts - tp AS fp, positives - tp AS fn, rows - alerts - positives + tp AS tn,
    tp::DOUBLE / alerts AS precision, coalesce(tp::DOUBLE / nullif(positives, 0), 0) AS recall,
    coalesce(2 * tp::DOUBLE / nullif(alerts + positives, 0), 0) AS f1, alerts::DOUBLE / rows AS alert_rate,
    alerts::DOUBLE / rows - 0.03 AS capacity_deviation, (alerts - tp + 100 * (positives - tp))::DOUBLE AS business_cost,
    100::DOUBLE * positives AS baseline_cost,
    coalesce((100::DOUBLE * positives - (alerts - tp + 100 * (positives - tp))) / nullif(100::DOUBLE * positives, 0), 0) AS cost_saving_rate,
    pr_auc, roc_auc FROM {p}pf JOIN {p}rr USING ({KS}))"""


LEDGER_METRICS = ledger_metrics_sql()
LM_DOUBLES = ("precision", "recall", "f1", "alert_rate", "capacity_deviation", "cost_saving_rate", "pr_auc", "roc_auc")


@query(
    "e08_ledger_metrics",
    f"WITH {LEDGER}, {LEDGER_METRICS} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in LM_DOUBLES)}) FROM lm",
)
def _(spark, d):
    return rounded(M.ledger_metrics(ledger(spark, d), K, "raw", "label", "id"))


@query(
    "e09_step_attribution",
    f"""WITH {LEDGER}, {RANKED} SELECT {KS}, time, count(*) AS rows,
  sum(CASE WHEN score_rank <= {slots(0.03)} THEN label ELSE 0 END)::BIGINT AS captured FROM rk GROUP BY {KS}, time""",
)
def _(spark, d):
    chosen = D.fixed_capacity(ledger(spark, d), K, "raw", "label", "id", 0.03)
    return M.step_attribution(chosen, K, "time", "label", "selected")


@query(
    "e10_ranking_record",
    f"""WITH {LEDGER_VALIDATION}, {curve_sql('platt', 'led_validation')}, {bins_sql('platt', 'led_validation')},
r AS (SELECT {KS}, {AP} AS pr_auc, {AUC} AS roc_auc FROM cv GROUP BY {KS}), b AS (SELECT {KS}, {BRIER} AS brier FROM bn_p GROUP BY {KS})
SELECT {KS}, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(brier, 6) AS brier, round(ece, 6) AS ece
FROM r JOIN b USING ({KS}) JOIN bn_e USING ({KS})""",
)
def _(spark, d):
    return rounded(M.ranking_record(ledger(spark, d, "validation"), K, "platt", "label"))


# ---- calibration -------------------------------------------------------------------------------

ISO = f"""lv AS (SELECT fold, raw AS x, avg(label) AS y, count(*)::DOUBLE AS w, row_number() OVER (PARTITION BY fold ORDER BY raw) AS i
  FROM led_validation WHERE model = 'PH' AND seed = 42 GROUP BY fold, raw),
cu AS (SELECT *, sum(y * w) OVER (PARTITION BY fold ORDER BY i) AS cy, sum(w) OVER (PARTITION BY fold ORDER BY i) AS cw FROM lv),
av AS (SELECT a.fold, a.i AS j, b.i AS k, (b.cy - a.cy + a.y * a.w) / (b.cw - a.cw + a.w) AS m FROM cu a JOIN cu b ON a.fold = b.fold AND b.i >= a.i),
mn AS (SELECT fold, j, k AS i, min(m) OVER (PARTITION BY fold, j ORDER BY k DESC) AS m FROM av),
iso AS (SELECT fold, i, max(m) AS isotonic FROM mn GROUP BY fold, i)"""


@query(
    "c02_isotonic",
    f"""WITH {LEDGER_VALIDATION}, {ISO}
SELECT fold, id, raw, round(greatest(0, least(1, isotonic)), 6) AS isotonic
FROM led_validation JOIN lv USING (fold) JOIN iso USING (fold, i) WHERE model = 'PH' AND seed = 42 AND raw = x AND fold = 1""",
)
def _(spark, d):
    """The cell that the quadratic SQL can hold against ``c02_isotonic_cells``."""
    rows = ledger(spark, d, "validation").where("model = 'PH' AND seed = 42 AND fold = 1")
    out = C.isotonic_apply(rows, K, "raw", C.isotonic_fit(rows, K, "raw", "label"))
    return rounded(out.select("fold", "id", "raw", "isotonic"))


def iso_sql(source, name="im"):
    """Isotonic rate of every level of every cell: the largest, over starts, of the least mean up to any end."""
    return f"""{name}_l AS MATERIALIZED (SELECT {KS}, raw AS x, sum(label)::BIGINT AS pos, count(*) AS n, row_number() OVER (PARTITION BY {KS} ORDER BY raw) AS i
  FROM {source} GROUP BY {KS}, raw),
{name}_c AS MATERIALIZED (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM {name}_l WINDOW w AS (PARTITION BY {KS} ORDER BY i)),
{name}_a AS (SELECT a.fold, a.seed, a.model, a.i AS j, b.i AS k, (b.cp - a.cp + a.pos)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE AS m
  FROM {name}_c a JOIN {name}_c b ON a.fold = b.fold AND a.seed = b.seed AND a.model = b.model AND b.i >= a.i),
{name}_m AS (SELECT {KS}, k AS i, min(m) OVER (PARTITION BY {KS}, j ORDER BY k DESC) AS m FROM {name}_a),
{name} AS MATERIALIZED (SELECT {KS}, x, isotonic, lead(x) OVER w AS nx, lead(isotonic) OVER w AS ni, min(x) OVER (PARTITION BY {KS}) AS x0
  FROM (SELECT {KS}, i, max(m) AS isotonic FROM {name}_m GROUP BY {KS}, i) JOIN {name}_l USING ({KS}, i) WINDOW w AS (PARTITION BY {KS} ORDER BY i))"""


@query(
    "c02_isotonic_cells",
    f"""WITH {LEDGER_VALIDATION}, {iso_sql('led_validation')}
SELECT {KS}, id, raw, round(isotonic, 6) AS isotonic FROM led_validation l JOIN im USING ({KS}) WHERE raw = x""",
)
def _(spark, d):
    """Every (fold, seed, model) cell, each with its own map, fitted on levels and joined to the rows."""
    rows = ledger(spark, d, "validation")
    levels = settle(M.score_levels(rows, K, "raw", "label"))
    out = C.isotonic_apply(rows, K, "raw", C.isotonic_fit(levels, K, "raw", M.LEVELS), levels=levels)
    return rounded(out.select(*K, "id", "raw", "isotonic"))


NEWTON = 16


def platt_sql(source, name="pm"):
    """Logistic maps of all cells by Newton steps on score levels, one table a step."""
    clip = "greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, raw))"
    steps = [f"""{name}_l AS MATERIALIZED (SELECT {KS}, ln({clip} / (1 - {clip})) AS z, label::DOUBLE AS y, count(*)::DOUBLE AS w FROM {source} GROUP BY ALL),
{name}_0 AS (SELECT DISTINCT {KS}, 0::DOUBLE AS slope, 0::DOUBLE AS intercept FROM {name}_l)"""]
    for i in range(NEWTON):
        steps.append(f"""{name}_{i + 1} AS MATERIALIZED (
  WITH p AS (SELECT *, 1 / (1 + exp(-(slope * z + intercept))) AS p FROM {name}_l JOIN {name}_{i} USING ({KS})),
  s AS (SELECT {KS}, slope, intercept, sum(w * (p - y)) AS g0, sum(w * (p - y) * z) AS g1, sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * z) AS h01,
    sum(w * p * (1 - p) * z * z) AS h11 FROM p GROUP BY {KS}, slope, intercept),
  f AS (SELECT *, slope - coalesce((h00 * g1 - h01 * g0) / nullif(h00 * h11 - h01 * h01, 0), 0) AS free FROM s)
  SELECT {KS}, greatest({C.LEAST_SLOPE}::DOUBLE, free) AS slope, CASE WHEN free >= {C.LEAST_SLOPE}::DOUBLE
    THEN intercept - coalesce((h11 * g0 - h01 * g1) / nullif(h00 * h11 - h01 * h01, 0), 0)
    ELSE intercept - coalesce((g0 + h01 * ({C.LEAST_SLOPE}::DOUBLE - slope)) / nullif(h00, 0), 0) END AS intercept FROM f)""")
    return ",\n".join(steps)


@query(
    "c01_platt",
    f"""WITH {LEDGER_BOTH}, {platt_sql('led_validation')} SELECT {KS}, id, raw, round(1 / (1 + exp(-(slope * ln(clipped / (1 - clipped)) + intercept))), 4) AS fitted
FROM ledger JOIN pm_{NEWTON} USING ({KS})""",
)
def _(spark, d):
    """Each cell is calibrated on its own fold's validation window."""
    fitted = C.platt_fit_cells(ledger(spark, d, "validation"), K, "raw", "label")
    return rounded(C.platt_apply_cells(ledger(spark, d), K, "raw", fitted, "fitted").select(*K, "id", "raw", "fitted"), 4)


@query(
    "c01_score_equations",
    f"""WITH {LEDGER_VALIDATION} SELECT {KS}, count(*) AS rows, sum(label)::BIGINT AS positives, CAST(round(sum(label)) AS BIGINT) AS expected, 1 AS balanced FROM led_validation GROUP BY {KS}""",
)
def _(spark, d):
    """A fitted map expects as many positives as there are, and leaves no slope in its errors unless the slope is at its bound."""
    rows = ledger(spark, d, "validation")
    fitted = C.platt_fit_cells(rows, K, "raw", "label")
    out = C.platt_apply_cells(rows, K, "raw", fitted, "fitted").join(fitted.select(*K, "slope"), K)
    z = X.logit(X.clip_score(F.col("raw")))
    tilt = F.abs(F.sum((F.col("fitted") - F.col("label")) * z)) / F.count("*")
    return out.groupBy(*K).agg(
        F.count("*").alias("rows"), F.sum("label").alias("positives"), F.round(F.sum("fitted")).cast("bigint").alias("expected"),
        ((tilt < 1e-6) | (F.max("slope") <= C.LEAST_SLOPE)).cast("int").alias("balanced"),
    )


@query(
    "c03_reliability_uniform",
    f"""WITH {LEDGER}, {bins_sql('platt', 'ledger')}, e(bin_id, lo, hi) AS (VALUES
  {", ".join(f"({i}, {EDGES10[i]!r}::DOUBLE, {EDGES10[i + 1]!r}::DOUBLE)" for i in range(10))})
SELECT k.fold, k.seed, k.model, e.bin_id, round(lo, 6) AS bin_lower, round(hi, 6) AS bin_upper, coalesce(sample_count, 0) AS sample_count,
  coalesce(positive_count, 0) AS positive_count, round(mean_predicted, 6) AS mean_predicted, round(observed_rate, 6) AS observed_rate
FROM (SELECT DISTINCT {KS} FROM ledger) k CROSS JOIN e LEFT JOIN bn_s b ON b.fold = k.fold AND b.seed = k.seed AND b.model = k.model AND b.bin_id = e.bin_id""",
)
def _(spark, d):
    return rounded(C.reliability_bins(ledger(spark, d), K, "platt", "label", "uniform", 10))


def quantile_bins_sql(score, source, name="qb", keys=KS):
    probs = ", ".join(repr(i / 10) for i in range(11))
    on = " AND ".join(f"l.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"l.{k.strip()}" for k in keys.split(","))
    return f"""{name}_e AS (SELECT {keys}, list_sort(list_distinct(quantile_cont({score}, [{probs}]))) AS ed FROM {source} GROUP BY {keys}),
{name} AS (SELECT {own}, least(len(list_filter(ed, lambda x: x <= {score})), len(ed) - 1) - 1 AS bin_id, any_value(ed) AS ed, count(*) AS sample_count,
    sum(label)::BIGINT AS positive_count, avg({score}) AS mean_predicted, avg(label) AS observed_rate
  FROM {source} l JOIN {name}_e e ON {on} GROUP BY ALL)"""


@query(
    "c03_reliability_quantile",
    f"""WITH {LEDGER}, {quantile_bins_sql('raw', 'ledger')}
SELECT {KS}, bin_id::INTEGER AS bin_id, round(ed[bin_id + 1], 6) AS bin_lower, round(ed[bin_id + 2], 6) AS bin_upper, sample_count, positive_count,
  round(mean_predicted, 6) AS mean_predicted, round(observed_rate, 6) AS observed_rate FROM qb""",
)
def _(spark, d):
    return rounded(C.reliability_bins(ledger(spark, d), K, "raw", "label", "quantile", 10))


@query(
    "c04_ece",
    f"""WITH {LEDGER}, {bins_sql('platt', 'ledger')} SELECT * REPLACE (round(ece, 6) AS ece, round(largest_share, 6) AS largest_share) FROM bn_e""",
)
def _(spark, d):
    return rounded(C.ece(ledger(spark, d), K, "platt", "label"))


@query(
    "c05_probability_metrics",
    f"""WITH {LEDGER}, p AS (SELECT *, raw AS p FROM ledger), {curve_sql()}, r AS (SELECT {KS}, {AP} AS ap FROM cv GROUP BY {KS})
SELECT {KS}, round({BRIER}, 6) AS brier, round({LOGLOSS}, 6) AS log_loss, round(any_value(ap), 6) AS ap FROM p JOIN r USING ({KS}) GROUP BY {KS}""",
)
def _(spark, d):
    return rounded(C.probability_metrics(ledger(spark, d), K, "raw", "label"))


TIES = """count(*) AS unique_outputs, count(*) FILTER (n > 1) AS tied_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS tied_rows,
  round(coalesce(sum(n) FILTER (n > 1), 0)::DOUBLE / sum(n), 6) AS tie_fraction, max(n) AS largest_tie, round(max(n)::DOUBLE / sum(n), 6) AS largest_share,
  round(coalesce(sum(n) FILTER (s = 0), 0)::DOUBLE / sum(n), 6) AS share_zero, round(coalesce(sum(n) FILTER (s = 1), 0)::DOUBLE / sum(n), 6) AS share_one"""


@query("c06_tie_statistics", f"WITH {LEDGER}, {curve_sql()} SELECT {KS}, {TIES} FROM cv GROUP BY {KS}")
def _(spark, d):
    return rounded(C.tie_statistics(ledger(spark, d), K, "raw"))


@query(
    "c07_boundary_percentile",
    f"""WITH {LEDGER}, lo AS (SELECT {KS}, min(raw) FILTER (platt >= 0.8) AS b FROM ledger GROUP BY {KS})
SELECT {KS}, round(coalesce(avg(CAST(raw <= b AS INTEGER)), 1), 6) AS boundary_percentile FROM ledger JOIN lo USING ({KS}) GROUP BY {KS}""",
)
def _(spark, d):
    rows = ledger(spark, d).withColumn("selected", (F.col("platt") >= 0.8).cast("int"))
    return rounded(C.boundary_percentile(rows, K, "raw", "selected"))


@query(
    "c08_jaccard",
    f"""WITH {LEDGER} SELECT {KS}, round(coalesce(count(*) FILTER (raw >= 0.7 AND platt >= 0.6)::DOUBLE
    / nullif(count(*) FILTER (raw >= 0.7 OR platt >= 0.6), 0), 1), 6) AS jaccard,
  count(*) FILTER ((raw >= 0.7) <> (platt >= 0.6)) AS disagreements,
  round(count(*) FILTER ((raw >= 0.7) <> (platt >= 0.6)) / count(*)::DOUBLE, 6) AS disagreement_rate FROM ledger GROUP BY {KS}""",
)
def _(spark, d):
    rows = ledger(spark, d).withColumns({"a": (F.col("raw") >= 0.7).cast("int"), "b": (F.col("platt") >= 0.6).cast("int")})
    return rounded(C.jaccard(rows, K, "a", "b"))


@query(
    "c09_spearman",
    f"""WITH {LEDGER}, pr AS (SELECT a.fold, a.seed, a.raw AS x, b.raw AS y FROM ledger a JOIN ledger b USING (fold, seed, id)
  WHERE a.model = 'P0' AND b.model = 'PHW'),
rk AS (SELECT fold, seed, rank() OVER (PARTITION BY fold, seed ORDER BY x) + (count(*) OVER (PARTITION BY fold, seed, x) - 1) / 2::DOUBLE AS rx,
    rank() OVER (PARTITION BY fold, seed ORDER BY y) + (count(*) OVER (PARTITION BY fold, seed, y) - 1) / 2::DOUBLE AS ry FROM pr)
SELECT fold, seed, round(corr(rx, ry), 6) AS spearman FROM rk GROUP BY fold, seed""",
)
def _(spark, d):
    rows = ledger(spark, d)
    a = rows.where("model = 'P0'").select("fold", "seed", "id", F.col("raw").alias("x"))
    b = rows.where("model = 'PHW'").select("fold", "seed", "id", F.col("raw").alias("y"))
    return rounded(C.spearman(a.join(b, ["fold", "seed", "id"]), ["fold", "seed"], "x", "y"))


METHODS = {"Uncalibrated": "raw", "Platt": "fitted", "Isotonic": "isotonic"}


def _fitted_sides(spark, d):
    """Score levels (n rows, pos positives) of the threshold and test rows of every cell, under its own fitted maps.

    The validation window is cut in time: maps are fitted on the first part, thresholds chosen on the second.
    Maps, thresholds and reports need counts of raw scores only, so a ledger is read once, into levels.
    """
    rows = ledger(spark, d, "validation")
    one = rows.where((F.col("seed") == SEEDS[0]) & (F.col("model") == next(iter(MODELS))))  # times and labels are those of every cell
    cut = calibration_threshold_boundaries(one, "time", "label", ["fold"]).select("fold", "last_time")
    split = rows.join(settle(cut), "fold").withColumn("early", F.col("time") <= F.col("last_time"))
    levels = stored(spark, d, "levels_validation", lambda: M.score_levels(split, [*K, "early"], "raw", "label"))
    test = stored(spark, d, "levels_test", lambda: M.score_levels(ledger(spark, d), K, "raw", "label"))
    first = levels.where("early").drop("early")
    platt, iso = C.platt_fit_cells(first, K, "raw", M.LEVELS), C.isotonic_fit(first, K, "raw", M.LEVELS)
    sides = []
    for name, side in (("threshold", levels.where("not early").drop("early")), ("test", test)):
        build = lambda side=side: C.isotonic_apply(C.platt_apply_cells(side, K, "raw", platt, "fitted"), K, "raw", iso)
        sides.append(stored(spark, d, f"fitted_{name}", build))
    return sides


def _branches(spark, d):
    """Threshold and test levels with a score column a method, and the result grid, evaluated once and written."""
    sides = _fitted_sides(spark, d)
    entries = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("score")) for m, c in METHODS.items()])
    long = [rows.withColumn("_m", F.explode(entries)).select(*K, "n", "pos", "raw", "_m.method", "_m.score") for rows in sides]
    grid = lambda: C.evaluate_branch(*long, [*K, "method"], "score", "raw", M.LEVELS)
    return sides[0], sides[1], stored(spark, d, "branches", grid)


def fitted_sql():
    """CTEs v1 and t1: threshold and test rows with the score columns of ``METHODS``."""
    clip = "greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, raw))"
    side = f"""SELECT l.*, 1 / (1 + exp(-(slope * ln({clip} / (1 - {clip})) + intercept))) AS fitted,
  CASE WHEN x IS NULL THEN f.first WHEN raw = x OR nx IS NULL OR ni = isotonic THEN isotonic ELSE isotonic + (ni - isotonic) / (nx - x) * (raw - x) END AS isotonic
FROM {{source}} l JOIN pm_{NEWTON} USING ({KS}) JOIN iso_first f USING ({KS})
  ASOF LEFT JOIN im ON l.fold = im.fold AND l.seed = im.seed AND l.model = im.model AND l.raw >= im.x"""
    return f"""{LEDGER_BOTH}, vg AS (SELECT fold, time, count(*) AS n, sum(label) AS pos FROM led_validation WHERE seed = {SEEDS[0]} AND model = '{next(iter(MODELS))}' GROUP BY ALL),
vc AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cum, sum(pos) OVER w AS cpos, sum(n) OVER (PARTITION BY fold) AS total,
    sum(pos) OVER (PARTITION BY fold) AS tpos, count(*) OVER (PARTITION BY fold) AS k FROM vg WINDOW w AS (PARTITION BY fold ORDER BY time)),
cut AS (SELECT fold, time AS last_time FROM vc WHERE i < k AND cpos > 0 AND cum - cpos > 0 AND tpos - cpos > 0 AND total - tpos - (cum - cpos) > 0
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY abs(cum - total / 2), i) = 1),
vfirst AS MATERIALIZED (SELECT l.* FROM led_validation l JOIN cut USING (fold) WHERE time <= last_time),
vlast AS (SELECT l.* FROM led_validation l JOIN cut USING (fold) WHERE time > last_time),
{platt_sql('vfirst')}, {iso_sql('vfirst')}, iso_first AS (SELECT {KS}, isotonic AS first FROM im WHERE x = x0),
v1 AS MATERIALIZED ({side.format(source='vlast')}), t1 AS MATERIALIZED ({side.format(source='ledger')})"""


def _branch_sql():
    """One CTE per method; the metric columns follow the branch table."""
    ctes, union = [], []
    for m, col in METHODS.items():
        t = m.lower()
        ctes.append(f"""{points_sql(col, 'v1', t + '_pt')},
{best_sql(t + '_b', t + '_pt', '(100::DOUBLE * fn + fp)', 'alerts::DOUBLE / rows <= 0.03')},
{t}_j AS (SELECT l.*, threshold, CAST({col} >= threshold AS INTEGER) AS alert FROM t1 l JOIN {t}_b USING ({KS})),
{confusion_sql(t + '_cf', t + '_j', 'alert = 1')},
{t}_vj AS (SELECT l.*, CAST({col} >= threshold AS INTEGER) AS alert FROM v1 l JOIN {t}_b USING ({KS})),
{t}_lo AS (SELECT {KS}, min(raw) FILTER (alert = 1) AS b FROM {t}_vj GROUP BY {KS}),
{t}_bp AS (SELECT {KS}, coalesce(avg(CAST(raw <= b AS INTEGER)), 1) AS boundary_percentile FROM {t}_vj JOIN {t}_lo USING ({KS}) GROUP BY {KS}),
{bins_sql(col, 'v1', t + '_ub_v')}, {bins_sql(col, 't1', t + '_ub_t')}, {quantile_bins_sql(col, 'v1', t + '_qb_v')}, {quantile_bins_sql(col, 't1', t + '_qb_t')},
{t}_qv AS (SELECT {KS}, sum(sample_count * abs(observed_rate - mean_predicted)) / sum(sample_count) AS ece FROM {t}_qb_v GROUP BY {KS}),
{t}_qt AS (SELECT {KS}, sum(sample_count * abs(observed_rate - mean_predicted)) / sum(sample_count) AS ece FROM {t}_qb_t GROUP BY {KS}),
{t}_pv AS (SELECT {KS}, {BRIER} AS brier, {LOGLOSS} AS log_loss FROM {t}_ub_v_p GROUP BY {KS}),
{t}_ptm AS (SELECT {KS}, {BRIER} AS brier, {LOGLOSS} AS log_loss FROM {t}_ub_t_p GROUP BY {KS}),
{curve_sql(col, 't1', t + '_cv')}, {curve_sql('raw', 't1', t + '_rv')},
{t}_ap AS (SELECT {KS}, {AP} AS ap FROM {t}_cv GROUP BY {KS}), {t}_rap AS (SELECT {KS}, {AP} AS ap FROM {t}_rv GROUP BY {KS}),
{t}_nc AS (SELECT {KS}, count(*) AS c FROM {t}_pt GROUP BY {KS}),
{t}_q AS (SELECT {KS}, quantile_cont({col}, 0.99) AS score_p99, quantile_cont({col}, 0.999) AS score_p999 FROM t1 GROUP BY {KS}),
{t}_ti AS (SELECT {KS}, {TIES} FROM {t}_cv GROUP BY {KS})""")
        tie = (
            "ti.unique_outputs, ti.tied_rows, ti.tie_fraction, ti.largest_tie"
            if m == "Isotonic"
            else "NULL::BIGINT AS unique_outputs, NULL::BIGINT AS tied_rows, NULL::DOUBLE AS tie_fraction, NULL::BIGINT AS largest_tie"
        )
        kept = {k: v for k, v in rates_sql(100).items() if k in ("precision", "recall", "f1", "alert_rate")}
        body = ", ".join(f"{v} AS {k}" for k, v in {**kept, **COSTS}.items())
        rate = kept["alert_rate"]
        union.append(f"""SELECT cf.*, {body}, {rate} - 0.03 AS capacity_deviation, abs({rate} - 0.03) AS capacity_deviation_abs,
  b.threshold, b.valrate AS validation_alert_rate, b.cost AS validation_cost, nc.c AS threshold_candidates, bp.boundary_percentile,
  pv.brier AS val_brier, pv.log_loss AS val_log_loss, ptm.brier AS test_brier, ptm.log_loss AS test_log_loss, ap.ap AS calibrated_ap, rap.ap AS raw_ap,
  q.score_p99, q.score_p999, uv.ece AS val_ece_uniform, qv.ece AS val_ece_quantile, ut.ece AS test_ece_uniform, qt.ece AS test_ece_quantile,
  {tie}, '{m}' AS method
FROM {t}_cf cf JOIN (SELECT {KS}, threshold, cost, alerts::DOUBLE / rows AS valrate FROM {t}_b) b USING ({KS}) JOIN {t}_nc nc USING ({KS})
  JOIN {t}_bp bp USING ({KS}) JOIN {t}_pv pv USING ({KS}) JOIN {t}_ptm ptm USING ({KS}) JOIN {t}_ap ap USING ({KS}) JOIN {t}_rap rap USING ({KS})
  JOIN {t}_q q USING ({KS}) JOIN {t}_ub_v_e uv USING ({KS}) JOIN {t}_qv qv USING ({KS}) JOIN {t}_ub_t_e ut USING ({KS}) JOIN {t}_qt qt USING ({KS})
  JOIN {t}_ti ti USING ({KS})""")
    return f"""{fitted_sql()}, {", ".join(ctes)}, br AS ({" UNION ALL BY NAME ".join(union)})"""


BRANCHES = _branch_sql()
BRANCH_DOUBLES = (
    "precision recall f1 alert_rate false_negative_cost false_positive_cost business_cost all_normal_cost cost_saving cost_saving_rate "
    "capacity_deviation capacity_deviation_abs threshold validation_alert_rate validation_cost boundary_percentile val_brier val_log_loss "
    "test_brier test_log_loss calibrated_ap raw_ap score_p99 score_p999 val_ece_uniform val_ece_quantile test_ece_uniform test_ece_quantile tie_fraction"
).split()


@query("c17_evaluate_branch", f"WITH {BRANCHES} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in BRANCH_DOUBLES)}) FROM br")
def _(spark, d):
    return rounded(_branches(spark, d)[2])


def _compare_sql():
    parts = []
    for m, col in METHODS.items():
        if m == "Uncalibrated":
            continue
        t = m.lower()
        sides = []
        for name, src in (("validation", "v1"), ("test", "t1")):
            a, b = "raw >= u.threshold", f"{col} >= w.threshold"
            sides.append(f"""(SELECT {KS}, round(coalesce(count(*) FILTER (({a}) AND ({b}))::DOUBLE / nullif(count(*) FILTER (({a}) OR ({b})), 0), 1), 6) AS {name}_jaccard,
      count(*) FILTER (({a}) <> ({b})) AS {name}_disagreements, round(count(*) FILTER (({a}) <> ({b}))::DOUBLE / count(*), 6) AS {name}_disagreement_rate
      FROM {src} JOIN uncalibrated_b u USING ({KS}) JOIN {t}_b w USING ({KS}) GROUP BY {KS})""")
        parts.append(f"""SELECT n.fold, n.seed, n.model, '{m} vs Uncalibrated' AS comparison,
  {", ".join(f"round(n.{c} - o.{c}, 6) AS {c}_difference" if c not in ("fp", "fn") else f"n.{c} - o.{c} AS {c}_difference"
             for c in ("recall", "fp", "fn", "business_cost", "alert_rate", "calibrated_ap"))},
  round(sp.spearman, 6) AS spearman, vj.* EXCLUDE ({KS}), tj.* EXCLUDE ({KS})
FROM br n JOIN br o ON o.fold = n.fold AND o.seed = n.seed AND o.model = n.model AND n.method = '{m}' AND o.method = 'Uncalibrated'
  JOIN (SELECT {KS}, corr(rx, ry) AS spearman FROM (SELECT {KS},
      rank() OVER (PARTITION BY {KS} ORDER BY raw) + (count(*) OVER (PARTITION BY {KS}, raw) - 1) / 2::DOUBLE AS rx,
      rank() OVER (PARTITION BY {KS} ORDER BY {col}) + (count(*) OVER (PARTITION BY {KS}, {col}) - 1) / 2::DOUBLE AS ry FROM v1) GROUP BY {KS}) sp
    ON sp.fold = n.fold AND sp.seed = n.seed AND sp.model = n.model
  JOIN {sides[0]} vj ON vj.fold = n.fold AND vj.seed = n.seed AND vj.model = n.model
  JOIN {sides[1]} tj ON tj.fold = n.fold AND tj.seed = n.seed AND tj.model = n.model""")
    return " UNION ALL BY NAME ".join(parts)


@query("c10_compare_decisions", f"WITH {BRANCHES} {_compare_sql()}")
def _(spark, d):
    val, test, results = _branches(spark, d)
    return rounded(C.compare_decisions(val, test, results, K, METHODS, "Uncalibrated", "n"))


PAIRS = [("Platt", "Uncalibrated"), ("Isotonic", "Uncalibrated"), ("Isotonic", "Platt")]
RELIABILITY = {
    "brier_improvement": "test_brier",
    "ece_uniform_improvement": "test_ece_uniform",
    "ece_quantile_improvement": "test_ece_quantile",
    "log_loss_improvement": "test_log_loss",
    "cost_reduction": "business_cost",
    "capacity_improvement": "capacity_deviation_abs",
}


@query(
    "c11_compare_reliability",
    f"""WITH {BRANCHES}, p(a, b) AS (VALUES {", ".join(str(p) for p in PAIRS)})
SELECT x.fold, x.seed, x.model, a || ' vs ' || b AS comparison, {", ".join(f"round(y.{c} - x.{c}, 6) AS {n}" for n, c in RELIABILITY.items())}
FROM p JOIN br x ON x.method = a JOIN br y ON y.method = b AND y.fold = x.fold AND y.seed = x.seed AND y.model = x.model""",
)
def _(spark, d):
    return rounded(C.compare_reliability(_branches(spark, d)[2], K, PAIRS))


SUMMARY = ["test_brier", "test_log_loss", "business_cost", "recall", "threshold"]


@query(
    "c12_calibration_summary",
    f"""WITH {BRANCHES} SELECT fold, model, method, {", ".join(
        f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std, round(min({m}), 6) AS {m}_min, round(max({m}), 6) AS {m}_max" for m in SUMMARY)},
  round(stddev_samp(threshold) / abs(avg(threshold)), 6) AS threshold_cv FROM br GROUP BY fold, model, method""",
)
def _(spark, d):
    return rounded(C.calibration_summary(_branches(spark, d)[2], ["fold", "model", "method"], SUMMARY))


@query(
    "c13_stage_audit",
    f"""WITH {LEDGER}, {curve_sql('raw', name='c1')}, {curve_sql('clipped', name='c2')}, {curve_sql('platt', name='c3')},
a AS (SELECT {KS}, {AP} AS raw_ap, count(*) AS raw_unique FROM c1 GROUP BY {KS}), b AS (SELECT {KS}, {AP} AS clipped_ap, count(*) AS clipped_unique FROM c2 GROUP BY {KS}),
c AS (SELECT {KS}, {AP} AS platt_ap, count(*) AS platt_unique FROM c3 GROUP BY {KS}),
r AS (SELECT {KS}, max(CAST(x <> y AS INTEGER)) AS differ FROM (SELECT {KS}, dense_rank() OVER (PARTITION BY {KS} ORDER BY clipped) AS x,
    dense_rank() OVER (PARTITION BY {KS} ORDER BY platt) AS y FROM ledger) GROUP BY {KS})
SELECT {KS}, count(*) FILTER (raw <= 1e-6) AS low_clipped, count(*) FILTER (raw >= 1 - 1e-6::DOUBLE) AS high_clipped,
  round(any_value(raw_ap), 9) AS raw_ap, any_value(raw_unique) AS raw_unique, round(any_value(clipped_ap), 9) AS clipped_ap,
  any_value(clipped_unique) AS clipped_unique, round(any_value(platt_ap), 9) AS platt_ap, any_value(platt_unique) AS platt_unique,
  1 - any_value(differ) AS same_partition
FROM ledger JOIN a USING ({KS}) JOIN b USING ({KS}) JOIN c USING ({KS}) JOIN r USING ({KS}) GROUP BY {KS}""",
)
def _(spark, d):
    return rounded(C.stage_audit(ledger(spark, d), K, "label"), 9)


@query(
    "c14_monotone_merge_audit",
    f"""WITH {LEDGER}, m AS (SELECT {KS}, raw, min(round(raw, 1)) AS lo, max(round(raw, 1)) AS hi FROM ledger GROUP BY {KS}, raw),
v AS (SELECT {KS}, count(*) AS input_unique, count(*) FILTER (prev > lo OR hi > lo) AS violations FROM (SELECT *, max(hi) OVER (PARTITION BY {KS}
    ORDER BY raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM m) GROUP BY {KS}),
o AS (SELECT {KS}, count(DISTINCT round(raw, 1)) AS output_unique FROM ledger GROUP BY {KS})
SELECT {KS}, input_unique, output_unique, CAST(violations = 0 AS INTEGER) AS weakly_monotone, input_unique - output_unique AS merged_groups, violations
FROM v JOIN o USING ({KS})""",
)
def _(spark, d):
    return C.monotone_merge_audit(_coarse(ledger(spark, d)), K, "raw", "ps")


@query(
    "c15_constant_reference",
    f"""WITH {LEDGER}, r AS (SELECT {KS}, avg(label) AS rate FROM ledger GROUP BY {KS})
SELECT {KS}, round(rate, 6) AS rate, round(rate * (1 - rate), 6) AS brier, round(-(rate * ln(rate) + (1 - rate) * ln(1 - rate)), 6) AS log_loss FROM r""",
)
def _(spark, d):
    return rounded(C.constant_reference(ledger(spark, d), K, "label"))


@query(
    "c16_score_difference",
    f"""WITH {LEDGER}, g AS (SELECT {KS}, abs(raw - platt) AS d FROM ledger)
SELECT {KS}, round(max(d), 6) AS max_difference, round(avg(d), 6) AS mean_difference, count(*) FILTER (d = 0) AS equal_rows,
  count(*) FILTER (d <> 0) AS different_rows, round(quantile_cont(d, 0.5), 6) AS median_difference, round(quantile_cont(d, 0.95), 6) AS p95_difference
FROM g GROUP BY {KS}""",
)
def _(spark, d):
    return rounded(C.score_difference(ledger(spark, d), K, "raw", "platt"))


# ---- scalar functions --------------------------------------------------------------------------


@query(
    "p02_amount_ratio",
    f"""WITH {TX}, m AS (SELECT *, avg(amount_cents) OVER (PARTITION BY recipient) / 100 AS mean FROM tx)
SELECT id, round(amount_cents / 100::DOUBLE / (mean + 1e-6::DOUBLE), 6) AS offset_ratio,
  round(coalesce(amount_cents / 100::DOUBLE / nullif(CASE WHEN label = 1 THEN 0 ELSE mean END, 0), 0), 6) AS zero_ratio FROM m""",
)
def _(spark, d):
    rows = tx(spark, d)
    means = rows.groupBy("recipient").agg((F.avg("amount_cents") / 100).alias("mean"))
    joined = rows.join(means, "recipient")
    amount = F.col("amount_cents") / F.lit(100.0)
    return rounded(
        joined.select(
            "id",
            X.ratio_offset(amount, F.col("mean")).alias("offset_ratio"),
            X.ratio_or_zero(amount, F.when(F.col("label") == 1, F.lit(0.0)).otherwise(F.col("mean"))).alias("zero_ratio"),
        )
    )


@query(
    "p03_fill_numeric",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 0 WHEN event_type IN ('view', 'click') THEN 0 ELSE value END AS value FROM events""",
)
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    odd = F.when(F.col("event_type") == "error", F.lit(float("inf"))).when(F.col("event_type") == "view", F.lit(float("nan"))).when(
        F.col("event_type") == "click", F.lit(None)
    ).otherwise(F.col("value"))
    return X.fill_numeric(rows.withColumn("value", odd), ["value"]).select("event_id", "value")


@query(
    "p07_clip_score",
    f"""WITH {LEDGER} SELECT {KS}, id, clipped, round(ln(clipped / (1 - clipped)), 6) AS logit, round(platt, 6) AS platt FROM ledger""",
)
def _(spark, d):
    rows = ledger(spark, d)
    return rows.select(*K, "id", "clipped", F.round(X.logit(F.col("clipped")), 6).alias("logit"), F.round("platt", 6).alias("platt"))


@query(
    "p07_clip_score_nulls",
    f"""WITH {LEDGER}, {GAPS} SELECT {KS}, id, CASE WHEN {WHOLE} THEN greatest(1e-6, least(1 - 1e-6, raw)) END AS clipped, CAST(coalesce({WHOLE}, false) AS INTEGER) AS defined FROM gaps""",
)
def _(spark, d):
    return _gaps(spark, d).select(*K, "id", X.clip_score(F.col("raw")).alias("clipped"), X.defined(F.col("raw")).cast("int").alias("defined"))


@query(
    "p08_cast_matrix",
    """SELECT event_id, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) AS value, CASE WHEN event_type <> 'error' THEN round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) END AS gap
FROM events""",
)
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn(
        "gap", F.when(F.col("event_type") == "error", F.lit(float("-inf"))).otherwise(F.col("value"))
    )
    out = X.cast_matrix(rows, ["value", "gap"])
    return out.select("event_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("value", "gap")])


@query(
    "p09_safe_divide",
    f"""WITH {TX} SELECT recipient, round(sum(label)::DOUBLE / nullif(count(*) FILTER (type = 'view' AND step % 7 = 0), 0), 6) AS quotient FROM tx GROUP BY 1""",
)
def _(spark, d):
    odd = F.sum(((F.col("type") == "view") & (F.col("step") % 7 == 0)).cast("bigint"))
    return rounded(tx(spark, d).groupBy("recipient").agg(X.safe_divide(F.sum("label"), odd).alias("quotient")))


@query(
    "p10_strict_sign",
    f"""WITH {TX}, s AS (SELECT recipient, step % 3 AS part, sum(CASE label WHEN 1 THEN 4 ELSE -1 END) AS v FROM tx GROUP BY ALL),
t AS (SELECT *, CASE WHEN v > 0 THEN 'positive' WHEN v < 0 THEN 'negative' ELSE 'zero' END AS sg FROM s)
SELECT recipient, string_agg(sg, '/' ORDER BY part) AS signs, CASE WHEN count(*) FILTER (v > 0) > count(*) FILTER (v < 0) THEN 'positive'
  WHEN count(*) FILTER (v > 0) < count(*) FILTER (v < 0) THEN 'negative' ELSE 'mixed' END AS majority FROM t GROUP BY 1""",
)
def _(spark, d):
    from riskframe.operators.effects import majority_sign, sign_string

    parts = tx(spark, d).groupBy("recipient", (F.col("step") % 3).alias("part")).agg(
        F.sum(F.when(F.col("label") == 1, 4).otherwise(-1)).alias("v")
    )
    return parts.groupBy("recipient").agg(sign_string("v", "part").alias("signs"), majority_sign("v").alias("majority"))


@query(
    "p11_review_slots",
    f"""WITH {TX}, c AS (SELECT step, count(*) AS rows FROM tx GROUP BY 1)
SELECT step, rows, {slots(0.01)} AS k1, {slots(0.03)} AS k3, {slots(0.05)} AS k5 FROM c""",
)
def _(spark, d):
    counted = tx(spark, d).groupBy("step").agg(F.count("*").alias("rows"))
    return counted.select("step", "rows", *[X.review_slots(F.col("rows"), q).alias(n) for q, n in ((0.01, "k1"), (0.03, "k3"), (0.05, "k5"))])


@query("p12_hash_priority", f"WITH {SHOP} SELECT id, sha256('review-order|' || id) AS priority FROM shop")
def _(spark, d):
    return shop(spark, d).select("id", X.hash_priority("review-order|", F.col("id")).alias("priority"))


@query(
    "p13_composition",
    """WITH c AS (SELECT event_type, CASE WHEN user_id % 5 > 0 THEN CAST(user_id % 5 AS VARCHAR) ELSE '<MISSING>' END AS k, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, k AS category, n AS found_count, round(n / sum(n) OVER (PARTITION BY event_type)::DOUBLE, 6) AS found_ratio FROM c""",
)
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("k", F.when(F.col("user_id") % 5 > 0, F.col("user_id") % 5))
    packed = X.composition(rows, ["event_type"], "k")
    parsed = F.from_json("composition", "map<string,struct<count:bigint,ratio:double>>")
    return packed.select("event_type", F.explode(parsed).alias("category", "v")).select(
        "event_type", "category", F.col("v.count").alias("found_count"), F.col("v.ratio").alias("found_ratio")
    )
