"""Queries over the moving time-block bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import bootstrap as B
from riskframe.operators import joins as J
from riskframe.operators import metrics as M
from riskframe.operators import replicates as R
from riskframe.plans.canon import LEDGER, MODELS, SEEDS, _ledger_sql, build_ledger, ledger, stored
from riskframe.plans.q_scores import AP, KS, LEDGER_METRICS, STAGES, K, curve_sql, rounded
from riskframe.plans.registry import query

#: Draws of the queries whose SQL twin copies every row, and of the interval queries that report (``..._1000``).
REPS, MANY, SEED = 40, 1_000, 71
E = [*K, "block_length", "replicate_id"]
CONTRASTS = [("history", "P0", "PH"), ("windows", "PH", "PHW"), ("pairs", "PH", "PP"), ("history_windows", "P0", "PHW"), ("history_pairs", "P0", "PP")]
METRICS = ["delta_ap", "delta_tp", "delta_recall", "cost_reduction"]


def draws_sql(lengths=("L",), name="dr", reps=REPS):
    return f"""tg AS (SELECT fold, time, row_number() OVER (PARTITION BY fold ORDER BY time) - 1 AS pos, count(*) OVER (PARTITION BY fold) AS groups
  FROM (SELECT DISTINCT fold, time FROM ledger)),
hd AS (SELECT DISTINCT fold, groups, unnest([{", ".join(lengths)}])::INTEGER AS block_length FROM (SELECT fold, groups,
    greatest(2, round_even(groups ** (1 / 3::DOUBLE), 0)::INTEGER) AS L FROM tg)),
bl AS (SELECT fold, groups, block_length, rep AS replicate_id, unnest(range(0, ceil(groups / block_length::DOUBLE)::BIGINT)) AS blk
  FROM hd, (SELECT unnest(range(1, {reps} + 1)) AS rep) WHERE block_length <= groups),
{name} AS (SELECT fold, block_length, replicate_id::INTEGER AS replicate_id, (blk * block_length + o)::INTEGER AS draw,
    (('0x' || substr(sha256(concat_ws('|', '{SEED}', fold, block_length, replicate_id, blk)), 1, 8))::BIGINT % (groups - block_length + 1) + o)::INTEGER AS pos
  FROM (SELECT *, unnest(range(0, block_length)) AS o FROM bl) WHERE blk * block_length + o < groups),
mu AS (SELECT fold, block_length, replicate_id, pos, count(*) AS mult FROM {name} GROUP BY ALL)"""


DRAWS = f"{LEDGER}, {draws_sql()}"
DRAWS_MANY = f"{LEDGER}, {draws_sql(reps=MANY)}"
RK = f"{KS}, block_length, replicate_id"


def reps_sql(score="raw", source="ledger", name="rt", keys=KS, q=(3, 100)):
    """Every replicate by brute force: weighted levels for AP, weighted rows for the budget."""
    r = f"{keys}, block_length, replicate_id"
    return f"""{name}_w AS (SELECT l.*, block_length, replicate_id, mult FROM {source} l JOIN tg USING (fold, time) JOIN mu USING (fold, pos)),
{name}_l AS (SELECT {r}, {score} AS s, sum(mult) AS n, sum(mult * label) AS p FROM {name}_w GROUP BY ALL),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {r} ORDER BY s DESC) AS cn, sum(p) OVER (PARTITION BY {r} ORDER BY s DESC) AS cp,
    sum(p) OVER (PARTITION BY {r}) AS tp FROM {name}_l),
{name}_a AS (SELECT {r}, sum(p::DOUBLE / nullif(tp, 0) * (cp::DOUBLE / cn)) AS ap FROM {name}_c GROUP BY {r}),
{name}_o AS (SELECT *, sum(mult) OVER (PARTITION BY {r} ORDER BY {score} DESC, id ROWS UNBOUNDED PRECEDING) - mult AS before,
    sum(mult) OVER (PARTITION BY {r}) AS n, sum(mult * label) OVER (PARTITION BY {r}) AS positives FROM {name}_w),
{name}_t AS (SELECT {r}, any_value(n)::BIGINT AS n, any_value(positives)::BIGINT AS positives, ((any_value(n) * {q[0]} + {q[1] - 1}) // {q[1]})::BIGINT AS alerts,
    sum(label * greatest(0, least(mult, (n * {q[0]} + {q[1] - 1}) // {q[1]} - before)))::BIGINT AS tp FROM {name}_o GROUP BY {r}),
{name} AS (SELECT * FROM {name}_t JOIN {name}_a USING ({r}))"""


def _draws(spark, d, lengths=("default",), reps=REPS):
    rows = ledger(spark, d)
    positions = B.time_positions(rows)
    return rows, positions, B.moving_blocks(positions, ["fold"], reps, SEED, lengths)


def _world(spark, d, lengths=("default",), where="true", reps=REPS):
    rows, positions, draws = _draws(spark, d, lengths, reps)
    mult = stored(spark, d, f"mult_{reps}_" + "_".join(map(str, lengths)), lambda: B.multiplicities(draws, ["fold"]))
    return B.with_position(rows.where(where), positions, ["fold"]), mult


def _table(spark, d, lengths=("default",), reps=REPS):
    def build():
        rows, mult = _world(spark, d, lengths, reps=reps)
        return R.vector_replicates(rows, mult, ["fold"], K, "raw", "label", "id")

    return stored(spark, d, f"replicates_{reps}_" + "_".join(map(str, lengths)), build)


@query("b02_moving_blocks", f"WITH {DRAWS} SELECT * FROM dr")
def _(spark, d):
    return _draws(spark, d)[2]


@query("b03_multiplicities", f"WITH {DRAWS} SELECT * FROM mu")
def _(spark, d):
    return B.multiplicities(_draws(spark, d)[2], ["fold"])


@query(
    "b04_draw_fingerprint",
    f"""WITH {DRAWS} SELECT fold, block_length, replicate_id, sha256(string_agg(pos::VARCHAR, ',' ORDER BY draw)) AS fingerprint, count(*) AS drawn
FROM dr GROUP BY ALL""",
)
def _(spark, d):
    return B.draw_fingerprint(_draws(spark, d)[2], ["fold"])


THRESHOLD = f"""tm0 AS (SELECT {RK}, sum(mult)::BIGINT AS n, sum(mult * label)::BIGINT AS positives, coalesce(sum(mult * label) FILTER (raw >= 0.7), 0)::BIGINT AS tp,
    coalesce(sum(mult * (1 - label)) FILTER (raw >= 0.7), 0)::BIGINT AS fp FROM ledger JOIN tg USING (fold, time) JOIN mu USING (fold, pos) GROUP BY {RK}),
tm AS (SELECT *, positives - tp AS fn, 100::DOUBLE * (positives - tp) + fp AS cost, tp::DOUBLE / nullif(positives, 0) AS recall,
    (100::DOUBLE * positives - 100 * (positives - tp) - fp) / nullif(100::DOUBLE * positives, 0) AS cost_saving_rate FROM tm0)"""


def _threshold(spark, d):
    rows, mult = _world(spark, d)
    return B.weighted_threshold_metrics(rows.withColumn("alert", (F.col("raw") >= 0.7).cast("int")), mult, ["fold"], K, "label", "alert")


@query(
    "b05_weighted_threshold_metrics",
    f"WITH {DRAWS}, {THRESHOLD} SELECT * REPLACE (round(recall, 6) AS recall, round(cost_saving_rate, 6) AS cost_saving_rate) FROM tm",
)
def _(spark, d):
    return rounded(_threshold(spark, d))


@query("b06_weighted_ap", f"WITH {DRAWS}, {reps_sql()} SELECT {RK}, round(ap, 9) AS ap FROM rt")
def _(spark, d):
    rows, mult = _world(spark, d)
    return rounded(B.weighted_ap(rows, mult, ["fold"], K, "raw", "label"), 9)


@query("b07_positive_level_ap", f"WITH {DRAWS}, {reps_sql()} SELECT {RK}, round(ap, 9) AS ap FROM rt")
def _(spark, d):
    rows, mult = _world(spark, d)
    return rounded(B.positive_level_ap(rows, mult, ["fold"], K, "raw", "label"), 9)


@query("b08_weighted_topk_tp", f"WITH {DRAWS}, {reps_sql()} SELECT {RK}, n, positives, alerts, tp FROM rt")
def _(spark, d):
    rows, mult = _world(spark, d)
    return B.weighted_topk_tp(rows, mult, ["fold"], K, "raw", "label", "id")


@query("b09_replicate_table", f"WITH {DRAWS}, {reps_sql()} SELECT * REPLACE (round(ap, 9) AS ap) FROM rt")
def _(spark, d):
    return rounded(_table(spark, d), 9)


PAIRED = f"""pc AS (SELECT a.fold, a.seed, a.block_length, a.replicate_id, c.id AS contrast, a.model AS baseline, b.model AS candidate, a.n, a.positives, a.alerts,
    CAST(a.n = b.n AND a.positives = b.positives AND a.alerts = b.alerts AS INTEGER) AS paired_ok, b.ap - a.ap AS delta_ap, b.tp - a.tp AS delta_tp,
    (b.tp - a.tp)::DOUBLE / nullif(a.positives, 0) AS delta_recall, 101::DOUBLE * (b.tp - a.tp) AS cost_reduction
  FROM (VALUES {", ".join(str(c) for c in CONTRASTS)}) c(id, base, cand) JOIN rt a ON a.model = base JOIN rt b ON b.model = cand AND b.fold = a.fold
    AND b.seed = a.seed AND b.block_length = a.block_length AND b.replicate_id = a.replicate_id)"""
PAIR_KEYS = ["fold", "seed", "block_length", "replicate_id"]


def _paired(spark, d, lengths=("default",), reps=REPS):
    return B.paired_components(_table(spark, d, lengths, reps), PAIR_KEYS, CONTRASTS)


@query(
    "b10_paired_components",
    f"WITH {DRAWS}, {reps_sql()}, {PAIRED} SELECT * REPLACE (round(delta_ap, 9) AS delta_ap, round(delta_recall, 9) AS delta_recall) FROM pc",
)
def _(spark, d):
    return rounded(_paired(spark, d), 9)


@query(
    "b10_transferred",
    f"""WITH {DRAWS}, {THRESHOLD} SELECT a.fold, a.seed, a.block_length, a.replicate_id, CAST(a.n = b.n AND a.positives = b.positives AS INTEGER) AS paired_ok,
  round((b.tp - a.tp)::DOUBLE / nullif(a.positives, 0), 9) AS delta_recall, a.cost - b.cost AS cost_reduction,
  round((b.tp + b.fp - a.tp - a.fp)::DOUBLE / a.n, 9) AS delta_alert_rate
FROM tm a JOIN tm b ON a.model = 'P0' AND b.model = 'PHW' AND b.fold = a.fold AND b.seed = a.seed AND b.block_length = a.block_length AND b.replicate_id = a.replicate_id""",
)
def _(spark, d):
    return rounded(B.transferred(_threshold(spark, d), PAIR_KEYS, "P0", "PHW"), 9)


MEANS = f"""sm0 AS (SELECT fold, block_length, replicate_id, contrast, any_value(positives) AS positives, {", ".join(
    f"CASE WHEN count(DISTINCT seed) = {len(SEEDS)} AND count({m}) = count(*) THEN avg({m}) END AS {m}" for m in METRICS[:2])} FROM pc GROUP BY ALL),
sm AS (SELECT * EXCLUDE (positives), delta_tp / nullif(positives, 0) AS delta_recall, 101::DOUBLE * delta_tp AS cost_reduction FROM sm0),
fm AS (SELECT block_length, replicate_id, contrast, {", ".join(
    f"CASE WHEN count(DISTINCT fold) = 3 AND count({m}) = count(*) THEN avg({m}) END AS {m}" for m in METRICS)} FROM sm GROUP BY ALL)"""
SEED_KEYS = ["fold", "block_length", "replicate_id", "contrast"]


def _seed_means(spark, d, lengths=("default",), reps=REPS):
    return B.seed_mean(_paired(spark, d, lengths, reps), SEED_KEYS, len(SEEDS))


def _fold_means(spark, d, lengths=("default",)):
    return B.fold_equal_mean(_seed_means(spark, d, lengths), SEED_KEYS[1:], 3, METRICS)


ROUND_M = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)


@query("b11_seed_mean", f"WITH {DRAWS}, {reps_sql()}, {PAIRED}, {MEANS} SELECT * REPLACE ({ROUND_M}) FROM sm")
def _(spark, d):
    return rounded(_seed_means(spark, d))


@query("b11_fold_equal_mean", f"WITH {DRAWS}, {reps_sql()}, {PAIRED}, {MEANS} SELECT * REPLACE ({ROUND_M}) FROM fm")
def _(spark, d):
    return rounded(_fold_means(spark, d))


def interval_sql(source, keys, value="value", confidence=0.95, name="iv", min_valid=0):
    a = (1 - confidence) / 2
    return f"""{name}_0 AS (SELECT {keys}, avg({value}) AS mean, quantile_cont({value}, 0.5) AS median, stddev_samp({value}) AS se,
    quantile_cont({value}, {a!r}) AS lower, quantile_cont({value}, {1 - a!r}) AS upper, avg(CAST({value} > 0 AS INTEGER)) AS share_positive,
    avg(CAST({value} < 0 AS INTEGER)) AS share_negative, avg(CAST({value} = 0 AS INTEGER)) AS share_zero, count(*) AS draws, count({value}) AS valid
  FROM {source} GROUP BY {keys}),
{name} AS (SELECT {keys}, round(mean, 6) AS mean, round(median, 6) AS median, round(se, 6) AS se,
    CASE WHEN valid >= {max(min_valid, 1)} THEN round(lower, 6) END AS lower, CASE WHEN valid >= {max(min_valid, 1)} THEN round(upper, 6) END AS upper,
    round(share_positive, 6) AS share_positive, round(share_negative, 6) AS share_negative, round(share_zero, 6) AS share_zero, draws, valid,
    draws - valid AS invalid, round((draws - valid) / draws::DOUBLE, 6) AS invalid_rate,
    CASE WHEN valid >= {max(min_valid, 1)} THEN 'reported' ELSE 'insufficient_valid_draws' END AS status,
    CAST(coalesce(lower <= 0 AND upper >= 0, true) AS INTEGER) AS crosses_zero FROM {name}_0)"""


def long_sql(source, keys, metrics, name="lg"):
    return f"{name} AS ({' UNION ALL '.join(f'SELECT {keys}, {chr(39)}{m}{chr(39)} AS metric, {m}::DOUBLE AS value FROM {source}' for m in metrics)})"


def _effect_intervals(spark, d, reps):
    long = B.melt(_seed_means(spark, d, reps=reps), SEED_KEYS, METRICS)
    return rounded(B.interval_summary(long, ["fold", "contrast", "metric"]))


EFFECTS = f"{reps_sql()}, {PAIRED}, {MEANS}, {long_sql('sm', 'fold, contrast', METRICS)}, {interval_sql('lg', 'fold, contrast, metric')} SELECT * FROM iv"


@query("b12_interval_summary", f"WITH {DRAWS}, {EFFECTS}")
def _(spark, d):
    return _effect_intervals(spark, d, REPS)


@query("b12_interval_summary_1000", f"WITH {DRAWS_MANY}, {EFFECTS}")
def _(spark, d):
    return _effect_intervals(spark, d, MANY)


FACTOR = {"P0": "B0", "PH": "B0H", "PP": "B1", "PHW": "B1H"}
FACTOR_CASE = "CASE model " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FACTOR.items()) + " END"
CELLS = ["B0", "B0H", "B1", "B1H", "H0", "H1", "D"]


def factorial_sql(source="rt", name="fs", value="tp"):
    pick = ", ".join(f"max(CASE WHEN {FACTOR_CASE} = '{c}' THEN {value} END) AS {c}" for c in ("B0", "B0H", "B1", "B1H"))
    return f"""{name}_w AS (SELECT fold, block_length, replicate_id, seed, {pick} FROM {source} GROUP BY ALL),
{name} AS (SELECT fold, block_length, replicate_id, {", ".join(f"avg({c})::DOUBLE AS {c}" for c in ("B0", "B0H", "B1", "B1H"))}, avg(B0H - B0) AS H0, avg(B1H - B1) AS H1,
    avg((B1H - B1) - (B0H - B0)) AS D FROM {name}_w GROUP BY ALL)"""


def _factorial(spark, d, lengths=("default",), metric="tp", reps=REPS):
    rows = _table(spark, d, lengths, reps)
    mapping = F.create_map(*[F.lit(x) for kv in FACTOR.items() for x in kv])
    return B.factorial_summary(rows.withColumn("cell", mapping[F.col("model")]), ["fold", "block_length", "replicate_id"], len(SEEDS), metric)


ROUND_C = ", ".join(f"round({c}, 6) AS {c}" for c in CELLS)


@query("b13_factorial_summary", f"WITH {DRAWS}, {reps_sql()}, {factorial_sql()} SELECT * REPLACE ({ROUND_C}) FROM fs")
def _(spark, d):
    return rounded(_factorial(spark, d))


THIRD = _ledger_sql("test", MODELS, "third", "purchase")


@query(
    "b13_cross_family",
    f"""WITH {LEDGER}, {THIRD}, {draws_sql()}, {reps_sql()}, {factorial_sql()}, {reps_sql(source='third', name='ro')}, {factorial_sql('ro', 'fo')}
SELECT fold, block_length, replicate_id, round(fs.H0 - fo.H0, 6) AS H0, round(fs.H1 - fo.H1, 6) AS H1, round(fs.D - fo.D, 6) AS D FROM fs JOIN fo USING (fold, block_length, replicate_id)""",
)
def _(spark, d):
    """History effects on one target minus those on another, on the same draws."""
    _, mult = _world(spark, d)
    other = stored(spark, d, "ledger_purchase", lambda: build_ledger(spark, d, "test", MODELS, "purchase"))
    build = lambda: R.vector_replicates(B.with_position(other, B.time_positions(other), ["fold"]), mult, ["fold"], K, "raw", "label", "id")
    mapping = F.create_map(*[F.lit(x) for kv in FACTOR.items() for x in kv])
    second = stored(spark, d, "replicates_purchase", build).withColumn("cell", mapping[F.col("model")])
    keys = ["fold", "block_length", "replicate_id"]
    families = {"error": _factorial(spark, d), "purchase": B.factorial_summary(second, keys, len(SEEDS), "tp")}
    summary = J.union_frames([table.withColumn("family", F.lit(name)) for name, table in families.items()])
    return rounded(B.cross_family(summary, keys, "family", "error", "purchase", ("H0", "H1", "D")))


LENGTHS = (7, 3, 14)


@query(
    "b14_bootstrap_orders",
    f"""WITH {LEDGER}, {draws_sql(("7", "3", "14"))}, {reps_sql()}, {factorial_sql()}, {long_sql('fs', 'fold, block_length', CELLS)},
{interval_sql('lg', 'fold, block_length, metric')}, {interval_sql('lg', 'fold, block_length, metric', confidence=0.9875, name='wide')}
SELECT iv.*, CASE WHEN metric = 'D' THEN wide.lower END AS wide_lower, CASE WHEN metric = 'D' THEN wide.upper END AS wide_upper
FROM iv JOIN wide USING (fold, block_length, metric)""".replace("SELECT iv.*, CASE WHEN metric", "SELECT iv.*, CASE WHEN iv.metric").replace("CASE WHEN metric = 'D' THEN wide.upper", "CASE WHEN iv.metric = 'D' THEN wide.upper"),
)
def _(spark, d):
    return _order_intervals(spark, d, REPS)


@query("b14_bootstrap_orders_1000")
def _(spark, d):
    return _order_intervals(spark, d, MANY)


def _order_intervals(spark, d, reps):
    long = B.melt(_factorial(spark, d, LENGTHS, reps=reps), ["fold", "block_length", "replicate_id"], CELLS)
    keys = ["fold", "block_length", "metric"]
    wide = B.interval_summary(long, keys, confidence=0.9875).select(
        *keys, *[F.when(F.col("metric") == "D", F.col(c)).alias(f"wide_{c}") for c in ("lower", "upper")]
    )
    return rounded(B.interval_summary(long, keys).join(wide, keys))


@query(
    "b15_family_difference",
    f"""WITH {DRAWS}, {reps_sql()}, {PAIRED}, {MEANS}, fam AS (SELECT a.fold, a.block_length, a.replicate_id, a.delta_ap AS a1, b.delta_ap AS b1, a.delta_tp::DOUBLE AS a2, b.delta_tp AS b2
  FROM pc a JOIN sm b ON a.contrast = 'history' AND a.seed = 42 AND b.contrast = 'history_windows' AND a.fold = b.fold AND a.block_length = b.block_length AND a.replicate_id = b.replicate_id),
lg AS (SELECT fold, 'delta_ap' AS metric, 'A' AS family, a1 AS value FROM fam UNION ALL SELECT fold, 'delta_ap', 'B', b1 FROM fam UNION ALL SELECT fold, 'delta_ap', 'A_minus_B', a1 - b1 FROM fam
  UNION ALL SELECT fold, 'delta_tp', 'A', a2 FROM fam UNION ALL SELECT fold, 'delta_tp', 'B', b2 FROM fam UNION ALL SELECT fold, 'delta_tp', 'A_minus_B', a2 - b2 FROM fam),
{interval_sql('lg', 'fold, metric, family')} SELECT * FROM iv""",
)
def _(spark, d):
    return _family_intervals(spark, d, REPS)


@query("b15_family_difference_1000")
def _(spark, d):
    return _family_intervals(spark, d, MANY)


def _family_intervals(spark, d, reps):
    keys = ["fold", "block_length", "replicate_id"]
    a = _paired(spark, d, reps=reps).where("contrast = 'history' AND seed = 42")
    b = _seed_means(spark, d, reps=reps).where("contrast = 'history_windows'")
    long = B.family_difference(a, b, keys, ["delta_ap", "delta_tp"])
    return rounded(B.interval_summary(long, ["fold", "metric", "family"]))


@query(
    "b16_stage_processing_effects",
    f"""WITH {DRAWS}, st1 AS (SELECT * FROM ({STAGES[len('st AS ('):-1]}) WHERE model IN ('P0', 'PH')), {reps_sql('score', 'st1', 'rt', KS + ', stage')},
ef AS (SELECT a.fold, a.seed, a.stage, a.block_length, a.replicate_id, b.ap - a.ap AS v FROM rt a JOIN rt b ON a.model = 'P0' AND b.model = 'PH' AND a.fold = b.fold AND a.seed = b.seed AND a.stage = b.stage
    AND a.block_length = b.block_length AND a.replicate_id = b.replicate_id),
wd AS (SELECT fold, seed, replicate_id, max(v) FILTER (stage = 'raw') AS r, max(v) FILTER (stage = 'clipped') AS c, max(v) FILTER (stage = 'platt') AS p FROM ef GROUP BY ALL),
lg AS (SELECT fold, seed, 'clipped_minus_raw' AS processing, c - r AS value FROM wd UNION ALL SELECT fold, seed, 'platt_minus_clipped', p - c FROM wd UNION ALL SELECT fold, seed, 'platt_minus_raw', p - r FROM wd)
SELECT fold, seed, processing, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS lower, round(quantile_cont(value, 0.975), 6) AS upper, count(*) AS draws, count(value) AS valid
FROM lg GROUP BY ALL""",
)
def _(spark, d):
    return _stage_intervals(spark, d, REPS)


@query("b16_stage_processing_effects_1000")
def _(spark, d):
    return _stage_intervals(spark, d, MANY)


def _stage_intervals(spark, d, reps):
    rows, mult = _world(spark, d, where="model IN ('P0', 'PH')", reps=reps)
    keys = [*K, "stage"]

    def build():
        long = M.melt_stages(R.level_counts(rows, K, ["raw", "clipped", "platt"], "label"))
        return R.vector_replicates(long, mult, ["fold"], keys, "score", "label", counted=True).drop("n", "positives")

    ap = stored(spark, d, f"stages_{reps}", build)
    base = ap.where("model = 'P0'").drop("model").withColumnRenamed("ap", "_a")
    effect = ap.where("model = 'PH'").drop("model").join(base, ["fold", "seed", "stage", "block_length", "replicate_id"])
    effect = effect.withColumn("delta", F.col("ap") - F.col("_a"))
    out = B.stage_processing_effects(effect, ["fold", "seed", "block_length", "replicate_id"], "delta")
    summary = B.interval_summary(out, ["fold", "seed", "processing"])
    return rounded(summary.select("fold", "seed", "processing", "mean", "lower", "upper", "draws", "valid")).withColumns(
        {c: F.col(c) + F.lit(0.0) for c in ("mean", "lower", "upper")}
    )


@query(
    "b17_occurrence_rows",
    f"""WITH {DRAWS} SELECT fold, id, replicate_id, unnest(range(1, mult + 1))::INTEGER AS occurrence
FROM ledger JOIN tg USING (fold, time) JOIN mu USING (fold, pos) WHERE seed = 42 AND model = 'P0'""",
)
def _(spark, d):
    rows, mult = _world(spark, d, where="seed = 42 AND model = 'P0'")
    return B.occurrence_rows(rows, mult, ["fold"]).select("fold", "id", "replicate_id", "occurrence")


@query(
    "b18_block_sensitivity",
    f"""WITH {LEDGER}, {draws_sql(("ceil(L / 2::DOUBLE)", "L", "2 * L"))}, {reps_sql()}, {PAIRED}, {MEANS}, {long_sql('sm', 'fold, block_length, contrast', METRICS)},
{interval_sql('lg', 'fold, block_length, contrast, metric')} SELECT * FROM iv""",
)
def _(spark, d):
    return _block_intervals(spark, d, REPS)


@query("b18_block_sensitivity_1000")
def _(spark, d):
    return _block_intervals(spark, d, MANY)


def _block_intervals(spark, d, reps):
    long = B.melt(_seed_means(spark, d, ("half", "default", "double"), reps), SEED_KEYS, METRICS)
    return rounded(B.interval_summary(long, ["fold", "block_length", "contrast", "metric"]))


@query(
    "b19_lag_diagnostics",
    f"""WITH {DRAWS}, se AS (SELECT fold, pos, avg(label) AS x FROM ledger JOIN tg USING (fold, time) GROUP BY ALL)
SELECT a.fold, k.lag, round(corr(a.x, b.x), 6) AS correlation, count(*) AS paired_groups FROM (VALUES (1), (3), (6)) k(lag), se a JOIN se b ON b.fold = a.fold AND b.pos = a.pos + k.lag
GROUP BY ALL""",
)
def _(spark, d):
    rows, _ = _world(spark, d)
    return rounded(B.lag_diagnostics(rows, ["fold"], "label", [1, 3, 6]))


@query(
    "b19_time_structure",
    f"""WITH {DRAWS}, gp AS (SELECT fold, lead(time) OVER (PARTITION BY fold ORDER BY time) - time AS g FROM tg), sz AS (SELECT fold, time, count(*) AS c FROM ledger GROUP BY ALL),
a AS (SELECT fold, quantile_cont(g, 0.5) AS gap_median, max(g) AS gap_max FROM gp GROUP BY 1)
SELECT fold, gap_median, gap_max, count(*) AS time_groups, quantile_cont(c, 0.5) AS size_median, max(c) AS size_max FROM sz JOIN a USING (fold) GROUP BY ALL""",
)
def _(spark, d):
    rows = ledger(spark, d)
    return B.time_structure(B.time_positions(rows), rows, ["fold"])


@query(
    "b20_block_span_summary",
    f"""WITH {DRAWS}, sp AS (SELECT a.fold, a.groups, block_length, b.time - a.time AS s FROM tg a JOIN hd USING (fold) JOIN tg b ON b.fold = a.fold AND b.pos = a.pos + block_length - 1)
SELECT fold, groups, block_length, count(*) AS eligible_blocks, min(s) AS span_min, quantile_cont(s, 0.5) AS span_median, max(s) AS span_max FROM sp GROUP BY ALL""",
)
def _(spark, d):
    return B.block_span_summary(B.time_positions(ledger(spark, d)), ["fold"])


@query(
    "b21_draw_distribution",
    f"""WITH {DRAWS}, {reps_sql()} SELECT {KS}, count(ap) AS draws, round(min(ap), 6) AS minimum, round(max(ap), 6) AS maximum, round(avg(ap), 6) AS mean, round(quantile_cont(ap, 0.5), 6) AS median,
  round(quantile_cont(ap, 0.025), 6) AS q025, round(quantile_cont(ap, 0.975), 6) AS q975 FROM rt GROUP BY {KS}""",
)
def _(spark, d):
    return rounded(B.draw_distribution(_table(spark, d), K, "ap"))


@query(
    "b22_version_paired_intervals",
    f"""WITH {DRAWS}, {reps_sql()} SELECT {KS}, 'ap' AS metric, 0::DOUBLE AS max_difference, count(*) AS draws, count(ap) AS valid FROM rt GROUP BY {KS}""",
)
def _(spark, d):
    """The all-level and the positive-level AP are two versions of one number."""
    rows, mult = _world(spark, d)
    old = B.weighted_ap(rows, mult, ["fold"], K, "raw", "label")
    new = B.positive_level_ap(rows, mult, ["fold"], K, "raw", "label")
    out = B.version_paired_intervals(old, new, E, ["ap"], K)
    return rounded(out).select(*K, "metric", "max_difference", "draws", "valid")


@query("b22_version_paired_intervals_1000")
def _(spark, d):
    """The stored AP over all levels, and one over positive levels alone, at the reporting number of draws."""
    rows, mult = _world(spark, d, reps=MANY)
    cells = R.level_counts(rows, K, ["raw"], "label")
    levels = B.positive_levels(cells.withColumn("_any", (F.col("_p") > 0).cast("int")), K, "raw", "_any")
    merged = cells.join(levels, [*K, "raw"], "left").withColumn("_at", F.coalesce("_level", F.lit(-1.0)))  # below every positive
    new = R.vector_replicates(merged.drop("_level"), mult, ["fold"], K, "_at", "label", counted=True).select(*E, "ap")
    out = B.version_paired_intervals(_table(spark, d, reps=MANY).select(*E, "ap"), new, E, ["ap"], K)
    return rounded(out).select(*K, "metric", "max_difference", "draws", "valid")


@query(
    "b23_observed_effects",
    f"""WITH {LEDGER}, {LEDGER_METRICS} SELECT a.fold, a.seed, round((b.tp - a.tp)::DOUBLE / a.positives, 6) AS delta_recall,
  100::DOUBLE * (b.tp - a.tp) + (a.fp - b.fp) AS cost_reduction, round((100::DOUBLE * (b.tp - a.tp) + (a.fp - b.fp)) * 100000 / a.rows, 6) AS cost_reduction_per_100k,
  round((100::DOUBLE * (b.tp - a.tp) + (a.fp - b.fp)) / (100::DOUBLE * a.positives), 6) AS delta_cost_saving_rate, round(b.pr_auc - a.pr_auc, 6) AS delta_pr_auc
FROM lm a JOIN lm b ON a.model = 'P0' AND b.model = 'PHW' AND a.fold = b.fold AND a.seed = b.seed""",
)
def _(spark, d):
    points = M.ledger_metrics(ledger(spark, d), K, "raw", "label", "id")
    return rounded(B.observed_effects(points, ["fold", "seed"], "P0", "PHW"))
