"""Queries over result grids and paired effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import audits as A
from riskframe.operators import decisions as D
from riskframe.operators import effects as R
from riskframe.operators import history as H
from riskframe.operators import metrics as M
from riskframe.operators import splits as S
from riskframe.plans.canon import BOUNDS, LEDGER, LEDGER_BOTH, LEDGER_TWO, SEEDS, TX, ledger, second_ledger, stored, tx
from riskframe.plans.q_bootstrap import CONTRASTS, FACTOR, FACTOR_CASE
from riskframe.plans.q_scores import AP, AUC, KS, LEDGER_METRICS, PICK, RANKED, STAGES, K, curve_sql, ledger_metrics_sql, points_sql, profile_sql, rounded, slots, z
from riskframe.plans.registry import query

CAPS, COSTS = [0.03, 0.05], [(10, 1), (100, 1)]
SCENARIO = ["fold", "seed", "cap", "fn_cost", "fp_cost"]


def metrics_grid(spark, d):
    return stored(spark, d, "metrics", lambda: M.ledger_metrics(ledger(spark, d), K, "raw", "label", "id"))


def scenarios(spark, d):
    """Thresholds chosen on validation, reported on test, for every cap and cost."""

    def build():
        val, test = ledger(spark, d, "validation"), ledger(spark, d)
        cuts = D.threshold_grid(val, K, "raw", "label", CAPS, COSTS)
        out = R.scenario_results(test, cuts, K, "raw", "label")
        return out.join(M.average_precision(test, K, "raw", "label").withColumnRenamed("ap", "pr_auc"), K)

    return stored(spark, d, "scenarios", build)


SC = f"""{LEDGER_BOTH}, {points_sql('raw', 'led_validation')}, gr AS (SELECT * FROM pt, (VALUES (0.03::DOUBLE), (0.05::DOUBLE)) c(cap),
  (VALUES (10::DOUBLE), (100::DOUBLE)) f(fn_cost) WHERE alerts::DOUBLE / rows <= cap
  QUALIFY {PICK.format(keys=KS + ', cap, fn_cost', cost='fn_cost * fn + fp')}),
s0 AS (SELECT {KS}, cap, fn_cost, 1::DOUBLE AS fp_cost, threshold, count(*) FILTER (label = 0 AND raw < threshold) AS tn, count(*) FILTER (label = 0 AND raw >= threshold) AS fp,
    count(*) FILTER (label = 1 AND raw < threshold) AS fn, count(*) FILTER (label = 1 AND raw >= threshold) AS tp FROM ledger JOIN gr USING ({KS}) GROUP BY ALL),
{curve_sql()}, ra AS (SELECT {KS}, {AP} AS pr_auc FROM cv GROUP BY {KS}),
sc AS (SELECT *, {z('tp', 'tp + fp')} AS precision, {z('tp', 'tp + fn')} AS recall, {z('2 * tp', '2 * tp + fp + fn')} AS f1, {z('tp + fp', 'tn + fp + fn + tp')} AS alert_rate,
    fn * fn_cost AS false_negative_cost, fp * fp_cost AS false_positive_cost, fn * fn_cost + fp * fp_cost AS business_cost, (tp + fn) * fn_cost AS all_normal_cost,
    (tp + fn) * fn_cost - fn * fn_cost - fp * fp_cost AS cost_saving, ((tp + fn) * fn_cost - fn * fn_cost - fp * fp_cost) / nullif((tp + fn) * fn_cost, 0) AS cost_saving_rate,
    {z('tp + fp', 'tn + fp + fn + tp')} - cap AS capacity_deviation, tp + fp + tn + fn AS rows, tp + fn AS positives, tp + fp AS alert_count FROM s0 JOIN ra USING ({KS}))"""
SC_DOUBLES = "threshold precision recall f1 alert_rate cost_saving_rate capacity_deviation pr_auc".split()


@query("m04_run_grid_scenarios", f"WITH {SC} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in SC_DOUBLES)}) FROM sc")
def _(spark, d):
    return rounded(scenarios(spark, d))


PW = f"""pw AS (SELECT a.fold, a.seed, a.cap, a.fn_cost, a.fp_cost, a.model, {", ".join(f"a.{m} - b.{m} AS delta_{m}" for m in R.PAIR_METRICS)},
    b.business_cost - a.business_cost AS business_cost_reduction, CAST(a.pr_auc > b.pr_auc AS INTEGER) AS pr_auc_win, CAST(a.recall > b.recall AS INTEGER) AS recall_win,
    CAST(a.business_cost < b.business_cost AS INTEGER) AS business_cost_win, CAST(a.cost_saving > b.cost_saving AS INTEGER) AS cost_saving_win
  FROM sc a JOIN sc b ON a.model <> 'P0' AND b.model = 'P0' AND a.fold = b.fold AND a.seed = b.seed AND a.cap = b.cap AND a.fn_cost = b.fn_cost)"""
ROUND_D = ", ".join(f"round(delta_{m}, 6) AS delta_{m}" for m in R.PAIR_METRICS)


@query("r01_pairwise_vs_baseline", f"WITH {SC}, {PW} SELECT * REPLACE ({ROUND_D}) FROM pw")
def _(spark, d):
    return rounded(R.pairwise_vs_baseline(scenarios(spark, d), SCENARIO, "P0"))


WINS = ("pr_auc", "recall", "business_cost", "cost_saving")


@query(
    "r02_aggregate_results",
    f"""WITH {SC}, {PW}, st AS (SELECT model, cap, fn_cost, fp_cost, {", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in R.PAIR_METRICS)} FROM sc GROUP BY ALL),
w AS (SELECT model, cap, fn_cost, fp_cost, count(*) AS comparisons, {", ".join(f"sum({m}_win)::BIGINT AS {m}_win_count, round(avg({m}_win), 6) AS {m}_win_rate" for m in WINS)} FROM pw GROUP BY ALL)
SELECT * FROM st LEFT JOIN w USING (model, cap, fn_cost, fp_cost)""",
)
def _(spark, d):
    return rounded(R.aggregate_results(scenarios(spark, d), ["model", "cap", "fn_cost", "fp_cost"], SCENARIO, "P0"))


PRIMARY = "cap = 0.03 AND fn_cost = 100"


@query(
    "r03_seed_summary",
    f"""WITH {SC} SELECT fold, model, {", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std, round(min({m}), 6) AS {m}_min, round(max({m}), 6) AS {m}_max" for m in ("recall", "business_cost"))},
  round(max(abs(capacity_deviation)), 6) AS capacity_deviation_max_abs, round(stddev_samp(threshold) / abs(avg(threshold)), 6) AS threshold_cv FROM sc WHERE {PRIMARY} GROUP BY ALL""",
)
def _(spark, d):
    return rounded(R.seed_summary(scenarios(spark, d).where(PRIMARY), ["fold", "model"], ["recall", "business_cost"]))


def _primary(spark, d):
    return R.primary_pairwise(scenarios(spark, d).where(PRIMARY), "P0", "PHW")


PRIMARY_SQL = f"pp AS (SELECT * FROM pw WHERE {PRIMARY} AND model = 'PHW')"


@query(
    "r04_primary_pairwise",
    f"WITH {SC}, {PW}, {PRIMARY_SQL} SELECT fold, seed, {ROUND_D}, business_cost_reduction FROM pp",
)
def _(spark, d):
    return rounded(_primary(spark, d))


RULES = {"recall": "delta_recall > 0", "business_cost": "business_cost_reduction > 0", "cost_saving": "delta_cost_saving > 0", "cost_saving_rate": "delta_cost_saving_rate > 0", "pr_auc": "delta_pr_auc > 0"}


@query(
    "r05_win_rates",
    f"""WITH {SC}, {PW}, {PRIMARY_SQL}, lg AS ({" UNION ALL ".join(f"SELECT fold, '{k}' AS metric, CAST({v} AS INTEGER) AS win FROM pp" for k, v in RULES.items())})
SELECT CASE WHEN grouping(fold) = 1 THEN 'Overall' ELSE 'Fold ' || fold END AS scope, metric, sum(win)::BIGINT AS win_count, count(*) AS comparisons, round(avg(win), 6) AS win_rate
FROM lg GROUP BY GROUPING SETS ((fold, metric), (metric))""",
)
def _(spark, d):
    return rounded(R.win_rates(_primary(spark, d)))


def effects_sql(comparisons, source="lm", name="pe"):
    fields = ("pr_auc", "roc_auc", "precision", "recall", "f1", "tp", "cost_saving_rate")
    return f"""{name} AS (SELECT a.fold, a.seed, c.id AS comparison, a.model AS baseline, b.model AS candidate, {", ".join(f"b.{m} - a.{m} AS delta_{m}" for m in fields)},
    a.business_cost - b.business_cost AS cost_reduction, CAST(a.alerts = b.alerts AS INTEGER) AS alerts_equal
  FROM (VALUES {", ".join(str(c) for c in comparisons)}) c(id, base, cand) JOIN {source} a ON a.model = base JOIN {source} b ON b.model = cand AND a.fold = b.fold AND a.seed = b.seed)"""


def summary_sql(source="pe", name="fe"):
    long = " UNION ALL ".join(f"SELECT comparison, fold, seed, '{m}' AS metric, {m}::DOUBLE AS v FROM {source}" for m in R.EFFECTS)
    return f"""{name} AS (SELECT comparison, fold, metric, avg(v) AS mean, stddev_samp(v) AS seed_std, min(v) AS min, max(v) AS max, count(*) FILTER (v > 0) AS positive_seeds,
    count(*) FILTER (v = 0) AS zero_seeds, count(*) FILTER (v < 0) AS negative_seeds FROM ({long}) GROUP BY ALL)"""


PE = f"{LEDGER}, {LEDGER_METRICS}, {effects_sql(CONTRASTS)}"
FE = f"{PE}, {summary_sql()}"


def _effects(spark, d):
    return R.paired_effects(metrics_grid(spark, d), CONTRASTS)


def _fold_effects(spark, d):
    return R.fold_effect_summary(_effects(spark, d))


@query(
    "r06_paired_effects",
    f"WITH {PE} SELECT * REPLACE ({', '.join(f'round(delta_{m}, 6) AS delta_{m}' for m in ('pr_auc', 'roc_auc', 'precision', 'recall', 'f1', 'cost_saving_rate'))}) FROM pe",
)
def _(spark, d):
    return rounded(_effects(spark, d))


@query(
    "r07_capacity_identity_audit",
    f"""WITH {PE} SELECT comparison, fold, seed, alerts_equal, delta_tp, cost_reduction AS observed, 101::DOUBLE * delta_tp AS expected,
  abs(cost_reduction - 101::DOUBLE * delta_tp) AS difference, CAST(alerts_equal = 1 AND abs(cost_reduction - 101 * delta_tp) <= 1e-12 AS INTEGER) AS passed FROM pe""",
)
def _(spark, d):
    return R.capacity_identity_audit(_effects(spark, d))


@query("r08_fold_effect_summary", f"WITH {FE} SELECT * REPLACE (round(mean, 6) AS mean, round(seed_std, 6) AS seed_std, round(min, 6) AS min, round(max, 6) AS max) FROM fe")
def _(spark, d):
    return rounded(_fold_effects(spark, d))


SIGN = "CASE WHEN {0} > 0 THEN 'positive' WHEN {0} < 0 THEN 'negative' ELSE 'zero' END"


@query(
    "r09_fold_equal_weight",
    f"""WITH {FE}, w AS (SELECT comparison, metric, {", ".join(f"max(mean) FILTER (fold = {f}) AS f{f}" for f in (1, 2, 3))} FROM fe GROUP BY ALL)
SELECT comparison, metric, round(f1, 6) AS fold1_effect, round(f2, 6) AS fold2_effect, round(f3, 6) AS fold3_effect, round((f1 + f2 + f3) / 3, 6) AS equal_weight_effect,
  concat_ws('/', {SIGN.format('f1')}, {SIGN.format('f2')}, {SIGN.format('f3')}) AS signs, (f1 > 0)::INT + (f2 > 0)::INT + (f3 > 0)::INT AS positive_folds,
  (f1 = 0)::INT + (f2 = 0)::INT + (f3 = 0)::INT AS zero_folds, (f1 < 0)::INT + (f2 < 0)::INT + (f3 < 0)::INT AS negative_folds FROM w""",
)
def _(spark, d):
    return rounded(R.fold_equal_weight(_fold_effects(spark, d)))


STABLE = ("pr_auc", "recall", "business_cost")
STABLE_LONG = "lo AS (" + " UNION ALL ".join(f"SELECT fold, model, '{m}' AS metric, {m}::DOUBLE AS v FROM lm" for m in STABLE) + ")"


@query(
    "r10_seed_stability",
    f"""WITH {LEDGER}, {LEDGER_METRICS}, {STABLE_LONG} SELECT fold, model, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
  round(max(v) - min(v), 6) AS range FROM lo GROUP BY ALL""",
)
def _(spark, d):
    return rounded(R.seed_stability(metrics_grid(spark, d), STABLE))


@query(
    "r11_seed_vs_temporal",
    f"""WITH {LEDGER}, {LEDGER_METRICS}, {STABLE_LONG}, p AS (SELECT fold, model, metric, avg(v) AS m, stddev_samp(v) AS s FROM lo GROUP BY ALL)
SELECT model, metric, round(avg(s), 6) AS mean_seed_std, round(max(m) - min(m), 6) AS between_fold_range, round(stddev_samp(m), 6) AS between_fold_std,
  round(CASE WHEN avg(s) > 0 THEN (max(m) - min(m)) / avg(s) END, 6) AS range_to_seed_std FROM p GROUP BY ALL""",
)
def _(spark, d):
    return rounded(R.seed_vs_temporal(metrics_grid(spark, d), STABLE))


@query(
    "r12_temporal_heterogeneity",
    f"""WITH {FE}, hh AS (SELECT id, count(*) OVER (PARTITION BY recipient ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rc,
    count(*) OVER (PARTITION BY recipient, origin ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc FROM tx),
tw AS (SELECT fold, avg(label) AS rate, avg(amount_cents) / 100 AS amount_mean, avg(CAST(rc > 0 AS INTEGER)) AS rh, avg(CAST(pc > 0 AS INTEGER)) AS ph
  FROM tx JOIN hh USING (id) JOIN bounds ON split = 'test' AND step BETWEEN start_time AND end_time GROUP BY fold),
w AS (SELECT comparison, fold, {", ".join(f"max(mean) FILTER (metric = '{m}') AS {m}" for m in R.EFFECTS)} FROM fe GROUP BY ALL)
SELECT comparison, fold, {", ".join(f"round({m}, 6) AS {m}" for m in R.EFFECTS)}, round(rate, 6) AS rate, round(amount_mean, 6) AS amount_mean, round(rh, 6) AS recipient_history,
  round(1 - rh, 6) AS recipient_cold_start, round(ph, 6) AS pair_history, round(1 - ph, 6) AS pair_cold_start FROM w JOIN tw USING (fold)""",
)
def _(spark, d):
    rows = tx(spark, d)
    features = H.build_entity_features(rows, {"recipient": ["recipient"], "pair": ["recipient", "origin"]}, time="step", category=None)
    placed = S.apply_boundaries(features, S.rolling_boundaries(rows)).where("split = 'test'")
    composition = placed.groupBy("fold").agg(F.avg("label").alias("rate"), (F.avg("amount_cents") / 100).alias("amount_mean"))
    availability = A.history_availability_by_fold(placed, ["recipient", "pair"])
    return rounded(R.temporal_heterogeneity(_fold_effects(spark, d), composition, availability, ["recipient", "pair"]))


@query(
    "r13_alignment",
    f"""WITH {FE}, w AS (SELECT comparison, fold, max(mean) FILTER (metric = 'delta_pr_auc') AS a, max(mean) FILTER (metric = 'delta_tp') AS t FROM fe GROUP BY ALL)
SELECT comparison, fold, round(a, 6) AS delta_pr_auc, round(t, 6) AS delta_tp, {SIGN.format('a')} AS ranking_sign, {SIGN.format('t')} AS capture_sign,
  CASE WHEN a = 0 OR t = 0 THEN 'Type E' WHEN a > 0 AND t > 0 THEN 'Type A' WHEN a < 0 AND t > 0 THEN 'Type B' WHEN a > 0 AND t < 0 THEN 'Type C' WHEN a < 0 AND t < 0 THEN 'Type D' ELSE 'Type F' END AS alignment_type
FROM w""",
)
def _(spark, d):
    return rounded(R.alignment(_fold_effects(spark, d)))


SECOND_PAIRS = [("S01", "S0", "SH"), ("S02", "S0", "SHW"), ("S12", "SH", "SHW")]
LINKS = [("history", "S01"), ("history_windows", "S02"), ("windows", "S12")]
FE2 = f"{LEDGER_TWO}, {LEDGER_METRICS}, {effects_sql(CONTRASTS)}, {summary_sql()}, {ledger_metrics_sql('second', 'z')}, {effects_sql(SECOND_PAIRS, 'zlm', 'zpe')}, {summary_sql('zpe', 'zfe')}"


def _second_effects(spark, d):
    return R.cross_run_effects(second_ledger(spark, d), SECOND_PAIRS)


@query(
    "r14_replication_matrix",
    f"""WITH {FE2}, a AS (SELECT comparison, metric, count(*) FILTER (mean > 0) AS u, count(*) FILTER (mean < 0) AS dn, string_agg({SIGN.format('mean')}, '/' ORDER BY fold) AS sg FROM fe GROUP BY ALL),
b AS (SELECT comparison, metric, count(*) FILTER (mean > 0) AS u, count(*) FILTER (mean < 0) AS dn, string_agg({SIGN.format('mean')}, '/' ORDER BY fold) AS sg FROM zfe GROUP BY ALL)
SELECT a.comparison, b.comparison AS other, a.metric, a.sg AS first_signs, b.sg AS second_signs,
  CASE WHEN a.u + a.dn = 0 OR b.u + b.dn = 0 THEN '{R.UNSETTLED}'
    ELSE list_extract({list(R.VERDICTS)}, 1 + 4 * (a.u > 0 AND a.dn > 0)::INTEGER + 2 * (b.u > 0 AND b.dn > 0)::INTEGER + (sign(a.u - a.dn) = sign(b.u - b.dn))::INTEGER) END AS classification
FROM (VALUES {", ".join(str(p) for p in LINKS)}) l(x, y) JOIN a ON a.comparison = x JOIN b ON b.comparison = y AND b.metric = a.metric""",
)
def _(spark, d):
    return R.replication_matrix(_fold_effects(spark, d), _second_effects(spark, d), LINKS)


@query(
    "r15_contrast_table",
    f"""WITH {LEDGER}, {profile_sql('raw', (0.01, 0.03, 0.05))}
SELECT a.fold, a.seed, a.q, c.id AS contrast, 1 AS complete, CAST(a.positives = b.positives AND a.alerts = b.alerts AS INTEGER) AS comparable, b.tp - a.tp AS delta_tp,
  round((b.tp - a.tp)::DOUBLE / a.positives, 6) AS delta_recall, 101::DOUBLE * (b.tp - a.tp) AS cost_reduction, b.tp_min - a.tp_max AS envelope_lower, b.tp_max - a.tp_min AS envelope_upper,
  round(b.tp_expectation - a.tp_expectation, 6) AS expected_delta_tp
FROM (VALUES {", ".join(str(c) for c in CONTRASTS)}) c(id, base, cand) JOIN pf a ON a.model = base JOIN pf b ON b.model = cand AND a.fold = b.fold AND a.seed = b.seed AND a.q = b.q""",
)
def _(spark, d):
    profiles = D.capacity_profile(ledger(spark, d), K, "raw", "label", [0.01, 0.03, 0.05], "id")
    return rounded(R.contrast_table(profiles, CONTRASTS, ["fold", "seed", "q"]))


@query(
    "r16_stage_contrasts",
    f"""WITH {LEDGER}, {STAGES}, {curve_sql('score', 'st', 'cv', KS + ', stage')}, ap AS (SELECT {KS}, stage, {AP} AS ap FROM cv GROUP BY {KS}, stage),
w AS (SELECT a.fold, a.seed, {", ".join(f"max(b.ap - a.ap) FILTER (a.stage = '{s}') AS {s}" for s in ("raw", "clipped", "platt"))}
  FROM ap a JOIN ap b ON a.model = 'P0' AND b.model = 'PHW' AND a.fold = b.fold AND a.seed = b.seed AND a.stage = b.stage GROUP BY ALL)
SELECT fold, seed, round(raw, 9) AS raw, round(clipped, 9) AS clipped, round(platt, 9) AS platt, round(clipped - raw, 9) + 0 AS clipped_minus_raw, round(platt - clipped, 9) + 0 AS platt_minus_clipped,
  round(platt - raw, 9) + 0 AS platt_minus_raw, 1 AS adds_up FROM w""",
)
def _(spark, d):
    stages = M.stage_metrics(M.melt_stages(ledger(spark, d)), [*K, "stage"], "score", "label")
    out = rounded(R.stage_contrasts(stages, ["fold", "seed"], "P0", "PHW"), 9)
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in ("clipped_minus_raw", "platt_minus_clipped", "platt_minus_raw")})


SIX = {("P0", 42): "A0", ("PH", 42): "A1", ("PHW", 42): "A2", ("P0", 43): "B0", ("PH", 43): "B1", ("PHW", 43): "B2"}


@query(
    "r17_interaction_contrasts",
    f"""WITH {LEDGER}, {LEDGER_METRICS}, w AS (SELECT fold, max(positives) AS p, max(alerts) AS k, {", ".join(f"max(tp) FILTER (model = '{m}' AND seed = {s}) AS {c}" for (m, s), c in SIX.items())}
  FROM lm GROUP BY fold)
SELECT fold, 1 AS comparable, p AS positives, A2 - A1 AS delta0_tp, B2 - B1 AS delta1_tp, (B2 - B1) - (A2 - A1) AS j_tp, round((A2 - A1)::DOUBLE / p, 6) AS delta0, round((B2 - B1)::DOUBLE / p, 6) AS delta1,
  round(((B2 - B1) - (A2 - A1))::DOUBLE / p, 6) AS interaction, A1 - A0 AS a1_minus_a0, A2 - A0 AS a2_minus_a0, B1 - B0 AS b1_minus_b0, B2 - B0 AS b2_minus_b0,
  round((A1 - A0)::DOUBLE / p, 6) AS a1_minus_a0_recall, round((A2 - A0)::DOUBLE / p, 6) AS a2_minus_a0_recall, round((B1 - B0)::DOUBLE / p, 6) AS b1_minus_b0_recall,
  round((B2 - B0)::DOUBLE / p, 6) AS b2_minus_b0_recall, least(p, k) - A1 AS headroom_a1, least(p, k) - B1 AS headroom_b1 FROM w""",
)
def _(spark, d):
    key = F.concat_ws("|", "model", "seed")
    names = F.create_map(*[F.lit(x) for (m, s), c in SIX.items() for x in (f"{m}|{s}", c)])
    rows = metrics_grid(spark, d).withColumn("cell", F.try_element_at(names, key)).where(F.col("cell").isNotNull())
    return rounded(R.interaction_contrasts(rows, ["fold"]))


@query(
    "r18_capture_exchange",
    f"""WITH {LEDGER}, {RANKED}, h AS (SELECT fold, seed, id, max(CAST(model = 'P0' AND score_rank <= {slots(0.03)} AS INTEGER)) AS a, max(CAST(model = 'PHW' AND score_rank <= {slots(0.03)} AS INTEGER)) AS b
  FROM rk WHERE label = 1 GROUP BY ALL),
c AS (SELECT fold, seed, count(*) FILTER (a = 1 AND b = 1) AS retained, count(*) FILTER (a = 0 AND b = 1) AS gained, count(*) FILTER (a = 1 AND b = 0) AS lost, count(*) FILTER (a = 0 AND b = 0) AS unfound FROM h GROUP BY ALL)
SELECT *, retained + lost AS tp_before, retained + gained AS tp_after, gained - lost AS delta_tp FROM c""",
)
def _(spark, d):
    rows = ledger(spark, d).where("model IN ('P0', 'PHW')")
    chosen = D.fixed_capacity(rows, K, "raw", "label", "id", 0.03)
    return R.capture_exchange(chosen, ["fold", "seed"], "id", "P0", "PHW")


@query(
    "r19_headroom",
    f"""WITH {LEDGER}, {LEDGER_METRICS}, w AS (SELECT fold, seed, max(positives) AS p, max(alerts) AS k, {", ".join(f"max(CASE WHEN {FACTOR_CASE} = '{c}' THEN tp END) AS {c}" for c in ("B0", "B0H", "B1", "B1H"))}
  FROM lm GROUP BY fold, seed), m AS (SELECT fold, max(p) AS p, max(k) AS k, avg(B1) AS b1, avg(B0H - B0) AS h0, avg(B1H - B1) AS h1, avg((B1H - B1) - (B0H - B0)) AS dd FROM w GROUP BY fold)
SELECT fold, p AS positives, k AS alerts, round(h0, 6) AS H0, round(h1, 6) AS H1, round(dd, 6) AS D, round(b1, 6) AS b1_tp, round(least(p, k) - b1, 6) AS headroom, round(least(p, k) - b1 - h0, 6) AS d_upper FROM m""",
)
def _(spark, d):
    from riskframe.operators.bootstrap import factorial_summary

    grid = metrics_grid(spark, d)
    mapping = F.create_map(*[F.lit(x) for kv in FACTOR.items() for x in kv])
    factorial = factorial_summary(grid.withColumn("cell", mapping[F.col("model")]), ["fold"], len(SEEDS), "tp")
    population = grid.groupBy("fold").agg(F.max("positives").alias("positives"), F.max("alerts").alias("alerts"))
    return rounded(R.headroom(factorial, population, ["fold"]))


@query(
    "r20_descriptive_comparisons",
    f"""WITH {LEDGER}, {LEDGER_METRICS}, m AS (SELECT fold, model, avg(pr_auc) AS pr_auc, avg(recall) AS recall FROM lm GROUP BY ALL)
SELECT a.fold, c.id AS comparison, round(b.pr_auc - a.pr_auc, 6) AS delta_pr_auc, round(b.recall - a.recall, 6) AS delta_recall
FROM (VALUES {", ".join(str(c) for c in CONTRASTS)}) c(id, base, cand) JOIN m a ON a.model = base JOIN m b ON b.model = cand AND a.fold = b.fold""",
)
def _(spark, d):
    return rounded(R.descriptive_comparisons(metrics_grid(spark, d), CONTRASTS, ["pr_auc", "recall"]))


@query(
    "r21_shared_priority_summary",
    f"""WITH {LEDGER}, coarse AS (SELECT *, round(raw, 1) AS ps FROM ledger), {profile_sql('ps', (0.03,), KS, 'coarse')},
m AS (SELECT p.*, trial, label, row_number() OVER (PARTITION BY p.fold, p.seed, p.model, q, trial ORDER BY sha256(concat_ws('|', 7, trial, p.fold, id)), id) AS r
  FROM pf p JOIN coarse l ON l.fold = p.fold AND l.seed = p.seed AND l.model = p.model AND l.ps = p.boundary_score, (SELECT unnest(range(20)) AS trial)),
t AS (SELECT {KS}, q, trial, any_value(above_tp) + count(*) FILTER (label = 1 AND r <= remaining) AS tp FROM m GROUP BY ALL),
e AS (SELECT a.fold, a.q, c.id AS contrast, a.trial, avg(b.tp - a.tp) AS v FROM (VALUES {", ".join(str(c) for c in CONTRASTS)}) c(id, base, cand) JOIN t a ON a.model = base
  JOIN t b ON b.model = cand AND a.fold = b.fold AND a.seed = b.seed AND a.q = b.q AND a.trial = b.trial GROUP BY ALL)
SELECT fold, q, contrast, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS trials FROM e GROUP BY ALL""",
)
def _(spark, d):
    rows = ledger(spark, d).withColumn("ps", F.round("raw", 1))
    trials = D.priority_trials(rows, K, "ps", "label", "id", [0.03], 20, ["fold"])
    return rounded(R.shared_priority_summary(trials, CONTRASTS, ["fold", "q"]))


@query(
    "r22_cross_run_effects",
    f"WITH {FE2} SELECT * REPLACE (round(mean, 6) AS mean, round(seed_std, 6) AS seed_std, round(min, 6) AS min, round(max, 6) AS max) FROM zfe",
)
def _(spark, d):
    return rounded(_second_effects(spark, d))
