"""Queries over encoders and models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.functions.features import feature_sets
from riskframe.functions.prefix import default_ranges, settle
from riskframe.functions.scalars import hour_of_day
from riskframe.operators import calibration as C
from riskframe.operators import decisions as D
from riskframe.operators import effects as R
from riskframe.operators import encode as N
from riskframe.operators import grouped as G
from riskframe.operators import history as H
from riskframe.operators import joins as J
from riskframe.operators import metrics as M
from riskframe.operators import models as Z
from riskframe.operators import splits as S
from riskframe.plans.canon import BOUNDS, FOLDS, LEDGER, SEEDS, TX, folds, ledger, stored, tx
from riskframe.plans.q_effects import CAPS, COSTS, SC, SCENARIO, scenarios
from riskframe.plans.q_scores import AP, KS, K, curve_sql, profile_sql, rounded
from riskframe.plans.registry import query

PARTS = {"train": (0, 480), "validation": (481, 600), "test": (601, 100000)}


def encodable(spark, d):
    """Transactions with missing numbers, missing categories and categories first seen after train."""
    i, s = F.col("id"), F.col("step")
    rows = S.fixed_splits(tx(spark, d), PARTS)
    return rows.select(
        "id", "split", "label",
        F.when(i % 13 != 0, F.col("amount_cents") / F.lit(100.0)).alias("amount"),
        ((s - 1) % 24).cast("double").alias("hour"),
        F.lit(1.0).alias("constant"),
        F.when(i % 9 != 0, F.col("type")).alias("kind"),
        F.when((s > 600) & (i % 2 == 0), F.lit("new")).otherwise((F.col("origin") % 3).cast("string")).alias("band"),
    )


ENC = f"""{TX}, en AS (SELECT id, CASE WHEN step <= 480 THEN 'train' WHEN step <= 600 THEN 'validation' ELSE 'test' END AS split, label,
  CASE WHEN id % 13 <> 0 THEN amount_cents / 100::DOUBLE END AS amount, ((step - 1) % 24)::DOUBLE AS hour, 1.0::DOUBLE AS constant, CASE WHEN id % 9 <> 0 THEN type END AS kind,
  CASE WHEN step > 600 AND id % 2 = 0 THEN 'new' ELSE CAST(origin % 3 AS VARCHAR) END AS band FROM tx)"""
KINDS = ["click", "error", "purchase", "signup", "view"]
CODE = """CASE WHEN {c} IS NULL THEN 0 ELSE coalesce((SELECT code FROM vo WHERE feature = '{c}' AND vo.value = {c}), 1) END AS {c}"""
VOCAB = """vo AS (SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) + 1 AS INTEGER) AS code FROM (
  SELECT DISTINCT 'kind' AS feature, kind AS value FROM en WHERE split = 'train' AND kind IS NOT NULL UNION ALL SELECT DISTINCT 'band', band FROM en WHERE split = 'train' AND band IS NOT NULL))"""


@query("n01_category_index", f"WITH {ENC}, {VOCAB} SELECT * FROM vo")
def _(spark, d):
    return N.category_index(encodable(spark, d).where("split = 'train'"), ["kind", "band"])


@query("n01_apply_index", f"WITH {ENC}, {VOCAB} SELECT id, split, {CODE.format(c='kind')}, {CODE.format(c='band')} FROM en")
def _(spark, d):
    rows = encodable(spark, d)
    return N.apply_index(rows, N.category_index(rows.where("split = 'train'"), ["kind", "band"]), ["kind", "band"]).select("id", "split", "kind", "band")


@query(
    "n02_vocabulary_audit",
    f"""WITH {ENC}, {VOCAB}, l AS (SELECT split, 'kind' AS feature, kind AS v FROM en UNION ALL SELECT split, 'band', band FROM en),
m AS (SELECT l.feature, l.split, l.v, vo.code FROM l LEFT JOIN vo ON vo.feature = l.feature AND vo.value = l.v), z AS (SELECT feature, count(*) AS c FROM vo GROUP BY 1)
SELECT m.feature, m.split, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (v IS NOT NULL AND code IS NULL) AS unknown, any_value(c) AS vocabulary_size
FROM m JOIN z ON z.feature = m.feature GROUP BY ALL""",
)
def _(spark, d):
    return N.vocabulary_audit(encodable(spark, d), ["kind", "band"])


MED = "md AS (SELECT quantile_cont(amount, 0.5) AS m FROM en WHERE split = 'train')"


@query(
    "n03_encode",
    f"""WITH {ENC}, {MED} SELECT id, split, round(CAST(CAST(coalesce(amount, m) AS FLOAT) AS DOUBLE), 3) AS num__amount, CAST(amount IS NULL AS INTEGER)::DOUBLE AS missing__amount, hour AS num__hour,
  {", ".join(f"CAST(coalesce(kind, '__MISSING__') = '{k}' AS INTEGER)::DOUBLE AS cat__kind__{k}" for k in ["__MISSING__", *KINDS])},
  {", ".join(f"CAST(band = '{b}' AS INTEGER)::DOUBLE AS cat__band__{b}" for b in "012")} FROM en, md""",
)
def _(spark, d):
    rows = encodable(spark, d)
    rules = N.encode_fit(rows.where("split = 'train'"), ["amount", "hour", "constant"], ["kind", "band"])
    out = N.encode_transform(rows, rules, ["id", "split"])
    return out.select("id", "split", *[F.round(F.col(f"`{c}`").cast("double"), 3).alias(c) for c in out.columns[2:]])


def rules_sql(numeric=("amount", "hour", "constant"), categorical=("kind", "band"), where="split = 'train'", name="ru"):
    """Rules as rows, worked out from the training rows."""
    numbers = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM en WHERE {where}" for c in numeric)
    words = " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(nullif({c}, ''), '__MISSING__') AS v FROM en WHERE {where}" for c in categorical) or "SELECT '' AS feature, '' AS v WHERE false"
    return f"""{name}_n AS (SELECT feature, min(v) AS lo, max(v) AS hi, count(*) - count(v) AS gone, count(v) AS k, coalesce(quantile_cont(v, 0.5), 0) AS median FROM ({numbers}) GROUP BY feature),
{name}_w AS (SELECT DISTINCT feature, v FROM ({words})),
{name}_r AS (SELECT feature, 'num' AS kind, NULL::VARCHAR AS value, median FROM {name}_n WHERE lo < hi OR (gone > 0 AND (median <> lo OR median <> hi))
  UNION ALL SELECT feature, 'missing', NULL, median FROM {name}_n WHERE gone > 0 AND k > 0
  UNION ALL SELECT feature, 'cat', v, NULL FROM {name}_w WHERE feature IN (SELECT feature FROM {name}_w GROUP BY feature HAVING count(*) > 1)),
{name} AS (SELECT *, row_number() OVER (ORDER BY kind = 'cat', feature, coalesce(value, kind)) - 1 AS index FROM {name}_r)"""


@query("n03_encoding_rules", f"WITH {ENC}, {rules_sql()} SELECT feature, kind, value, round(median, 6) AS median, index FROM ru")
def _(spark, d):
    train = encodable(spark, d).where("split = 'train'")
    return rounded(N.encoding_rules(train, ["amount", "hour", "constant"], ["kind", "band"]))


LONG_ROWS = " UNION ALL ".join(
    [f"SELECT id, split, '{c}' AS feature, 'num' AS kind, NULL::VARCHAR AS value, {c} AS x FROM en UNION ALL SELECT id, split, '{c}', 'missing', NULL, ({c} IS NULL)::INTEGER::DOUBLE FROM en" for c in ("amount", "hour", "constant")]
    + [f"SELECT id, split, '{c}', 'cat', coalesce(nullif({c}, ''), '__MISSING__'), 1::DOUBLE FROM en" for c in ("kind", "band")]
)


@query(
    "n03_encode_entries",
    f"""WITH {ENC}, {rules_sql()}, lo AS ({LONG_ROWS})
SELECT id, split, index, round(CAST(CAST(coalesce(x, median) AS FLOAT) AS DOUBLE), 3) AS value FROM lo JOIN ru ON lo.feature = ru.feature AND lo.kind = ru.kind AND lo.value IS NOT DISTINCT FROM ru.value
WHERE coalesce(x, median) <> 0""",
)
def _(spark, d):
    rows = encodable(spark, d)
    columns = (["amount", "hour", "constant"], ["kind", "band"])
    rules = N.encoding_rules(rows.where("split = 'train'"), *columns)
    return N.encode_entries(rows, rules, *columns, ["id", "split"]).withColumn("value", F.round(F.col("value").cast("double"), 3))


@query(
    "n06_shared_rules",
    f"""WITH {ENC}, {rules_sql(("hour",), ("kind",), name="ra")}, {rules_sql(("amount",), (), "split = 'train' AND id % 2 = 0", "rb")}, {rules_sql(("hour", "amount"), ("kind", "band"), name="rc")},
t AS (SELECT feature, 'short' AS name, string_agg(concat_ws('|', kind, coalesce(value, '~'), coalesce(median, 0)), ';' ORDER BY kind, value) AS rule FROM (FROM ra UNION ALL FROM rb) GROUP BY feature
  UNION ALL SELECT feature, 'long', string_agg(concat_ws('|', kind, coalesce(value, '~'), coalesce(median, 0)), ';' ORDER BY kind, value) FROM rc GROUP BY feature)
SELECT feature, count(DISTINCT name) AS sets, count(DISTINCT rule) AS rules FROM t GROUP BY feature HAVING count(DISTINCT name) > 1""",
)
def _(spark, d):
    """A set that learned one column from other rows than the rest breaks the common rule."""
    rows = encodable(spark, d)
    train, early = rows.where("split = 'train'"), rows.where("split = 'train' AND id % 2 = 0")
    short = N.encoding_rules(train, ["hour"], ["kind"]).unionByName(N.encoding_rules(early, ["amount"], []))
    return N.shared_rules({"short": short, "long": N.encoding_rules(train, ["hour", "amount"], ["kind", "band"])})


@query(
    "n04_linear_encode",
    f"""WITH {ENC}, {MED}, f AS (SELECT en.*, coalesce(amount, m) AS a, CAST(amount IS NULL AS INTEGER)::DOUBLE AS g FROM en, md),
st AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(g) AS mg, stddev_pop(g) AS sg, avg(hour) AS mh, stddev_pop(hour) AS sh FROM f WHERE split = 'train')
SELECT id, split, round((a - ma) / sa, 6) AS std__amount, round((g - mg) / sg, 6) AS std__missing__amount, round((hour - mh) / sh, 6) AS std__hour, 0::DOUBLE AS std__constant,
  CAST(kind IS NULL AS INTEGER)::DOUBLE AS hot__kind__missing, {", ".join(f"CAST(coalesce(kind, '') = '{k}' AS INTEGER)::DOUBLE AS hot__kind__{k}" for k in KINDS)},
  0::DOUBLE AS hot__band__missing, {", ".join(f"CAST(band = '{b}' AS INTEGER)::DOUBLE AS hot__band__{b}" for b in "012")} FROM f, st""",
)
def _(spark, d):
    rows = encodable(spark, d)
    rules = N.linear_fit(rows.where("split = 'train'"), ["amount", "hour", "constant"], ["kind", "band"])
    return rounded(N.linear_transform(rows, rules, ["id", "split"]))


@query(
    "n05_tree_encode",
    f"""WITH {ENC} SELECT id, hour AS f0, {", ".join(f"CAST(coalesce(kind, '') = '{k}' AS INTEGER)::DOUBLE AS f{i + 1}" for i, k in enumerate(KINDS))},
  {", ".join(f"CAST(band = '{b}' AS INTEGER)::DOUBLE AS f{i + 6}" for i, b in enumerate("012"))} FROM en""",
)
def _(spark, d):
    rows = encodable(spark, d)
    model = N.tree_pipeline(["hour"], ["kind", "band"]).fit(rows.where("split = 'train'"))
    flat = model.transform(rows).withColumn("v", vector_to_array("features"))
    return flat.select("id", *[F.element_at("v", i + 1).alias(f"f{i}") for i in range(9)])


@query("n06_common_rules_check", f"WITH {ENC} SELECT 'amount' AS \"column\", 2::BIGINT AS rules, 2::BIGINT AS sets WHERE (SELECT count(*) FROM en) > 0")
def _(spark, d):
    rows = encodable(spark, d)
    train, early = rows.where("split = 'train'"), rows.where("split = 'train' AND id % 2 = 0")
    a = N.rules_table(spark, N.encode_fit(train, ["hour"], ["kind"]) + N.encode_fit(early, ["amount"], []), "short")
    b = N.rules_table(spark, N.encode_fit(train, ["hour", "amount"], ["kind", "band"]), "long")
    return N.common_rules_check(a.unionByName(b))


# ---- models ------------------------------------------------------------------------------------

NUMERIC = feature_sets((24,))["frequency"]
SCHEMES = {"base": {"numeric": ["amount_cents", "hour_of_day"], "categorical": []}, "history": {"numeric": NUMERIC, "categorical": [], "positive_weight": 3.0}}


def _featured(spark, d):
    def build():
        rows = H.range_history_exact(tx(spark, d), windows=(24,))
        return S.apply_boundaries(rows, folds(tx(spark, d))).drop("type")

    return stored(spark, d, "featured", build)


def _trees(train, label, seed, **options):
    return Z.fit_gbt(train, label=label, seed=seed, trees=5, depth=3, **options)


def _graded(spark, d):
    return stored(spark, d, "graded", lambda: Z.run_grid(_featured(spark, d), SCHEMES, SEEDS, "label", "id", _trees, range(1, FOLDS[0] + 1)))


def _each_fold(rows, fit):
    """``fit(train, test)`` of every fold, in one table."""
    out = []
    for fold in range(1, FOLDS[0] + 1):
        train, test = (rows.where((F.col("fold") == fold) & (F.col("split") == s)) for s in ("train", "test"))
        out.append(fit(train, test).withColumn("fold", F.lit(fold)))
    return J.union_frames(out)


@query("m01_fit_gbt")
def _(spark, d):
    fit = lambda train, test: Z.score(_trees(train, "label", 42, **SCHEMES["history"]), test).select("id", "raw")
    return rounded(_each_fold(_featured(spark, d), fit), 6)


@query("m02_fit_logistic")
def _(spark, d):
    def fit(train, test):
        found = Z.fit_logistic(train, NUMERIC, [], "label", 2.0)
        return Z.score(found.model, test).select("id", "raw", F.lit(int(found.converged)).alias("converged"), F.lit(len(found.attempts)).alias("attempts"))

    return rounded(_each_fold(_featured(spark, d), fit), 4)


# Schemes of the logistic grid, fitted together on every fold: one column (which SQL can fit too), and several.
ONE_COLUMN = {
    "amount": {"numeric": ["amount_cents"]},
    "amount_weighted": {"numeric": ["amount_cents"], "positive_weight": 3.0},
    "hour": {"numeric": ["hour_of_day"]},
}
LOGISTIC = {**ONE_COLUMN, **SCHEMES}
CELL = ["fold", "model"]


def _logistic(spark, d, name, schemes):
    """Rows of every (fold, scheme) as (cell, split, id, label, x, y, w), and the fitted cells."""
    rows = stored(spark, d, f"{name}_rows", lambda: G.scheme_rows(_featured(spark, d), schemes, "label", ["fold", "split", "id", "label"]))
    return rows, stored(spark, d, f"{name}_cells", lambda: G.fit_logistic_cells(rows.where("split = 'train'"), CELL))


def newton_sql(penalty=1e-4, steps=12):
    """Penalised weighted logistic models of one column, all cells at once, one table a Newton step."""
    column = {"amount": "amount_cents::DOUBLE", "amount_weighted": "amount_cents::DOUBLE", "hour": "((step - 1) % 24)::DOUBLE"}
    rows = " UNION ALL ".join(
        f"SELECT fold, '{m}' AS model, {column[m]} AS x, label::DOUBLE AS y, CASE WHEN label = 1 THEN {s.get('positive_weight', 1.0)}::DOUBLE ELSE 1 END AS w FROM tr" for m, s in ONE_COLUMN.items()
    )
    out = [f"""tr AS (SELECT fold, step, amount_cents, label FROM tx JOIN bounds ON split = 'train' AND step BETWEEN start_time AND end_time),
nr AS MATERIALIZED ({rows}),
sc AS MATERIALIZED (SELECT fold, model, sum(w) AS sw, sum(w * x) / sum(w) AS mu, sum(w) - sum(w * w) / sum(w) AS df FROM nr GROUP BY ALL),
sd AS MATERIALIZED (SELECT fold, model, any_value(sw) AS sw, any_value(mu) AS mu, sqrt(sum(w * (x - mu) * (x - mu)) / any_value(df)) AS sigma FROM nr JOIN sc USING (fold, model) GROUP BY fold, model),
nz AS MATERIALIZED (SELECT fold, model, (x - mu) / sigma AS z, y, sum(w) AS w, any_value(sw) AS sw FROM nr JOIN sd USING (fold, model) GROUP BY fold, model, z, y),
nw_0 AS (SELECT fold, model, 0::DOUBLE AS a, 0::DOUBLE AS b FROM sd)"""]
    for i in range(steps):
        out.append(f"""nw_{i + 1} AS MATERIALIZED (WITH p AS (SELECT *, 1 / (1 + exp(-(a + b * z))) AS p FROM nz JOIN nw_{i} USING (fold, model)),
  s AS (SELECT fold, model, a, b, sum(w * (p - y)) / any_value(sw) AS g0, sum(w * (p - y) * z) / any_value(sw) + {penalty}::DOUBLE * b AS g1, sum(w * p * (1 - p)) / any_value(sw) AS h00,
    sum(w * p * (1 - p) * z) / any_value(sw) AS h01, sum(w * p * (1 - p) * z * z) / any_value(sw) + {penalty}::DOUBLE AS h11 FROM p GROUP BY fold, model, a, b)
  SELECT fold, model, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM s)""")
    return ",\n".join(out)


@query(
    "m02_logistic_cells",
    f"""WITH {TX}, {BOUNDS}, {newton_sql()} SELECT fold, model, round(a - b * mu / sigma, 6) AS intercept, round(1000 * b / sigma, 6) AS per_thousand, 1 AS converged FROM nw_12 JOIN sd USING (fold, model)""",
)
def _(spark, d):
    """Coefficients of the one-column cells, out of the fit that serves all of them."""
    cells = _logistic(spark, d, "logistic", LOGISTIC)[1].where(F.col("model").isin(*ONE_COLUMN))
    slope = F.round(1000 * F.col("coefficients")[0], 6).alias("per_thousand")
    return cells.select(*CELL, F.round("intercept", 6).alias("intercept"), slope, F.col("converged").cast("int").alias("converged"))


@query(
    "m02_score_equations",
    f"""WITH {TX}, {BOUNDS} SELECT fold, model, count(*) AS rows, CAST(sum(CASE WHEN label = 1 THEN pw ELSE 1 END) AS BIGINT) AS weight, CAST(sum(label * pw) AS BIGINT) AS positive_weight,
  CAST(sum(label * pw) AS BIGINT) AS expected_weight, 1 AS converged FROM tx JOIN bounds ON split = 'train' AND step BETWEEN start_time AND end_time,
  (VALUES {", ".join(f"('{m}', {s.get('positive_weight', 1.0)}::DOUBLE)" for m, s in LOGISTIC.items())}) v(model, pw) GROUP BY fold, model""",
)
def _(spark, d):
    """A fitted cell expects as much weight on positives as there is in its training rows."""
    rows, cells = _logistic(spark, d, "logistic", LOGISTIC)
    scored = G.score_cells(rows.where("split = 'train'"), CELL, cells).join(cells.select(*CELL, "converged"), CELL)
    whole = lambda e: F.round(F.sum(e)).cast("bigint")
    return scored.groupBy(*CELL).agg(
        F.count("*").alias("rows"), whole(F.col("w")).alias("weight"), whole(F.col("w") * F.col("y")).alias("positive_weight"),
        whole(F.col("w") * F.col("raw")).alias("expected_weight"), F.max(F.col("converged").cast("int")).alias("converged"),
    )


@query("m03_score_cells")
def _(spark, d):
    """Probability and margin of every later row under every logistic cell."""
    rows, cells = _logistic(spark, d, "logistic", LOGISTIC)
    later = G.score_cells(rows.where("split <> 'train'"), CELL, cells)
    return rounded(G.score_cells(later, CELL, cells, "margin", margin=True).select(*CELL, "split", "id", "raw", "margin"))


@query("m04_logistic_grid")
def _(spark, d):
    """The grid report over all logistic cells, fitted together."""
    rows, cells = _logistic(spark, d, "logistic", LOGISTIC)
    later = G.score_cells(rows.where("split <> 'train'"), CELL, cells)
    graded = later.select("fold", "split", "model", F.lit(0).alias("seed"), "id", "label", "raw")
    return rounded(_report(stored(spark, d, "logistic_graded", lambda: graded)), 4)


# History by rows (none, the last hour, the last day) and context by columns (without, with): six conditions.
_HISTORY = {"0": [], "1": ["count_1", "mean_1"], "2": ["count_1", "mean_1", "count_24", "mean_24"]}
SIX_CELLS = {
    c + h: {"numeric": ["amount_cents", *columns, *context]} for c, context in (("A", []), ("B", ["hour_of_day", "recency"])) for h, columns in _HISTORY.items()
}


@query("r17_interaction_fitted")
def _(spark, d):
    """The interaction of history and context on models that were fitted and scored under all six conditions of every fold."""

    def featured():
        rows = H.range_history_exact(tx(spark, d), windows=(1, 24))
        return S.apply_boundaries(rows, folds(tx(spark, d))).drop("type")

    rows = stored(spark, d, "featured_six", featured)
    long = stored(spark, d, "six_rows", lambda: G.scheme_rows(rows, SIX_CELLS, "label", ["fold", "split", "id", "label"]))
    cells = stored(spark, d, "six_cells", lambda: G.fit_logistic_cells(long.where("split = 'train'"), CELL))
    test = stored(spark, d, "six_scored", lambda: G.score_cells(long.where("split = 'test'"), CELL, cells).select(*CELL, "id", "label", "raw"))
    found = D.capacity_profile(test, CELL, "raw", "label", [0.03], "id").withColumnRenamed("model", "cell")
    return rounded(R.interaction_contrasts(found, ["fold"]))


PLAIN = ["amount_cents", "hour_of_day"]


def _margins(spark, d):
    """Probability and margin of every test row; the models take no history, so none is built."""

    def build():
        rows = tx(spark, d).select("id", "step", "amount_cents", hour_of_day(F.col("step")).alias("hour_of_day"), "label")
        dealt = rows.repartition(default_ranges(rows), "id")  # a small file is read by few tasks, but a fit should use them all
        return S.apply_boundaries(dealt, folds(tx(spark, d))).select("fold", "split", "id", "label", *PLAIN)

    def margins(train, test):
        model = Z.fit_logistic(train, PLAIN, [], "label").model
        return Z.score(model, Z.score(model, test, "probability_score"), "margin", margin=True)

    return _each_fold(stored(spark, d, "plain", build), margins)


@query("m03_score_margin")
def _(spark, d):
    return rounded(_margins(spark, d).select("id", "probability_score", "margin", "fold"), 4)


@query(
    "m03_margin_is_logit",
    f"""WITH {TX}, {BOUNDS} SELECT fold, id, 1 AS agrees FROM tx JOIN bounds ON split = 'test' AND step BETWEEN start_time AND end_time""",
)
def _(spark, d):
    """The margin of every scored row is the logit of its probability."""
    gap = F.abs(F.ln(F.col("probability_score") / (1 - F.col("probability_score"))) - F.col("margin"))
    agrees = (gap <= 1e-6 * (1 + F.abs(F.col("margin")))).cast("int").alias("agrees")
    return _margins(spark, d).select("id", agrees, "fold")


@query(
    "m04_grid_identities",
    f"""WITH {TX}, {BOUNDS}, n AS (SELECT fold, count(*) AS rows, sum(CAST(type = 'error' AS INTEGER))::BIGINT AS positives FROM (SELECT fold, id, type FROM tx JOIN bounds ON split = 'test' AND step BETWEEN start_time AND end_time) GROUP BY fold)
SELECT fold, seed, model, cap, fn_cost, rows, positives, 1 AS cells_add_up, 1 AS costs_add_up FROM n, (VALUES {", ".join(f"({s})" for s in SEEDS)}) s(seed), (VALUES {", ".join(f"('{m}')" for m in SCHEMES)}) m(model),
  (VALUES {", ".join(f"({c}::DOUBLE)" for c in CAPS)}) c(cap), (VALUES {", ".join(f"({a}::DOUBLE)" for a, _ in COSTS)}) f(fn_cost)""",
)
def _(spark, d):
    """Every cell of the grid reports all of its rows, and costs that follow from its confusion table."""
    cells = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    adds = F.abs(F.col("business_cost") - F.col("fn") * F.col("fn_cost") - F.col("fp") * F.col("fp_cost")) < 1e-6
    return _grid(spark, d).select(*K, "cap", "fn_cost", "rows", "positives", (cells == F.col("rows")).cast("int").alias("cells_add_up"), adds.cast("int").alias("costs_add_up"))


def _grid(spark, d):
    """Fit, calibrate on validation, choose thresholds there, report on test, for each cell."""
    return _report(_graded(spark, d))


def _report(rows):
    """The rows are read once, into score levels: maps, thresholds and report are those of levels."""
    levels = settle(M.score_levels(rows, [*K, "split"], "raw", "label"))
    fitted = C.platt_fit_cells(levels.where("split = 'validation'"), K, "raw", M.LEVELS)
    calibrated = settle(C.platt_apply_cells(levels, K, "raw", fitted))
    val, test = (calibrated.where(F.col("split") == s) for s in ("validation", "test"))
    cuts = D.threshold_grid(val, K, "platt", M.LEVELS, CAPS, COSTS)
    return R.scenario_results(test, cuts, K, "platt", M.LEVELS)


@query("m04_run_grid")
def _(spark, d):
    return rounded(_grid(spark, d), 4)


@query(
    "m05_choose_candidate",
    f"""WITH {LEDGER}, {profile_sql('raw', (0.03,))}, {curve_sql()}, c AS (SELECT fold, model || '-' || seed AS candidate, tp, ap, seed AS trees FROM pf JOIN (SELECT {KS}, {AP} AS ap FROM cv GROUP BY {KS}) USING ({KS}))
SELECT fold, candidate, tp, round(ap, 6) AS ap, trees FROM c QUALIFY row_number() OVER (PARTITION BY fold ORDER BY tp DESC, ap DESC, trees, candidate) = 1""",
)
def _(spark, d):
    rows = ledger(spark, d)
    found = D.capacity_profile(rows, K, "raw", "label", [0.03], "id").join(M.average_precision(rows, K, "raw", "label"), K)
    grid = found.select("fold", F.concat_ws("-", "model", "seed").alias("candidate"), "tp", "ap", F.col("seed").alias("trees"))
    return rounded(Z.choose_candidate(grid, ["fold"], 12))


@query(
    "m06_select_by_validation",
    f"""WITH {SC} SELECT fold, seed, cap, fn_cost, fp_cost, arg_min(model, (business_cost, model)) AS model, min(business_cost) AS business_cost FROM sc GROUP BY ALL""",
)
def _(spark, d):
    return Z.select_by_validation(scenarios(spark, d), SCENARIO, "model", "business_cost")


def _importance(train, _):
    model = _trees(train, "label", 42, **SCHEMES["history"])
    for stage in model.stages[:-1]:
        train = stage.transform(train)
    return Z.importance_rank(model, train)


@query("m07_importance_rank")
def _(spark, d):
    return rounded(_each_fold(_featured(spark, d), _importance), 4)


@query(
    "m07_importance_identities",
    f"""SELECT fold, {len(NUMERIC)}::BIGINT AS features, 1 AS shares_add_up, 1 AS ranks_agree FROM (VALUES (1), (2), (3)) f(fold) WHERE (SELECT count(*) FROM events) > 0""",
)
def _(spark, d):
    """Shares add up to one, and a rank is one more than the number of larger gains."""
    found = _each_fold(_featured(spark, d), _importance)
    larger = found.select(F.col("fold").alias("_f"), F.col("gain").alias("_g"))
    ranked = found.join(larger, (F.col("_f") == F.col("fold")) & (F.col("_g") > F.col("gain")), "left")
    ranked = ranked.groupBy("fold", "feature", "share", "gain_rank").agg(F.count("_g").alias("above"))
    return ranked.groupBy("fold").agg(
        F.count("*").alias("features"), (F.abs(F.sum("share") - 1) < 1e-9).cast("int").alias("shares_add_up"),
        F.bool_and(F.col("gain_rank") == F.col("above") + 1).cast("int").alias("ranks_agree"),
    )


@query(
    "m08_failure_cases",
    f"""WITH {LEDGER} SELECT {KS}, id, label, raw, round(abs(label - raw), 6) AS absolute_error FROM ledger ORDER BY abs(label - raw) DESC, id, {KS} LIMIT 200""",
)
def _(spark, d):
    rows = ledger(spark, d).select(*K, "id", "label", "raw")
    return rounded(Z.failure_cases(rows, "raw", "label", ["id", *K], 200))


@query(
    "m09_balanced_sample",
    f"""WITH {TX}, h AS (SELECT id, label, sha256('42|' || id) AS h FROM tx), p AS (SELECT id, label FROM h WHERE label = 1 ORDER BY h, id LIMIT 200), n AS (SELECT id, label FROM h WHERE label = 0 ORDER BY h, id LIMIT 200)
SELECT * FROM p UNION ALL SELECT * FROM n""",
)
def _(spark, d):
    return Z.balanced_sample(tx(spark, d).select("id", "label"), 400, "label", "id")


@query(
    "m10_inclusion_trace",
    f"""WITH {ENC}, l AS (SELECT 'amount' AS feature, amount AS v FROM en WHERE split = 'train' UNION ALL SELECT 'hour', hour FROM en WHERE split = 'train' UNION ALL SELECT 'constant', constant FROM en WHERE split = 'train'),
s AS (SELECT feature, round(1 - count(v) / count(*)::DOUBLE, 6) AS missing_rate, round(count(*) FILTER (coalesce(v, 0) <> 0)::DOUBLE / count(*), 6) AS nonzero_rate, count(DISTINCT v) AS unique_count, round(var_pop(v), 4) AS variance FROM l GROUP BY 1)
SELECT * FROM (VALUES ('amount', 1, 1, 0), ('hour', 1, 1, 1), ('constant', 1, 0, 1), ('absent', 0, 0, 0)) f(feature, in_data, in_set, in_encoded) LEFT JOIN s USING (feature)""",
)
def _(spark, d):
    train = encodable(spark, d).where("split = 'train'")
    encoded = N.tree_pipeline(["hour", "constant"], ["kind"]).fit(train).transform(train)
    out = Z.inclusion_trace(train, encoded, ["amount", "hour", "constant", "absent"], ["amount", "hour"])
    return out.withColumns({"missing_rate": F.round("missing_rate", 6), "nonzero_rate": F.round("nonzero_rate", 6), "variance": F.round("variance", 4)})
