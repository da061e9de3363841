"""Validators on tables with planted faults: every count is worked out from the data, and none is zero by nature."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import audits as A
from riskframe.operators import checks as V
from riskframe.operators import decisions as D
from riskframe.operators import history as H
from riskframe.operators import joins as J
from riskframe.plans.canon import CARD, LEDGER, LEDGER_BOTH, MODELS, SEEDS, TX, card, ledger, tx
from riskframe.plans.q_audits import ENTITIES
from riskframe.plans.q_bootstrap import DRAWS, PAIRED, REPS, _paired, reps_sql
from riskframe.plans.q_effects import SC, SCENARIO, metrics_grid, scenarios
from riskframe.plans.q_scores import K, KS, LEDGER_METRICS, profile_sql
from riskframe.plans.registry import query

SEED_LIST = ", ".join(map(str, SEEDS))


def _table(rows: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS \"check\", CAST(({value}) AS DOUBLE) AS violations" for name, value in rows.items())


def _count(condition: str, source: str = "f") -> str:
    return f"SELECT count(*) FILTER ({condition}) FROM {source}"


@query(
    "v12_compare_exact_faults",
    f"WITH {TX} SELECT 2 * count(*) FILTER (id % 13 = 0 OR label = 1)::BIGINT AS violations FROM tx",
)
def _(spark, d):
    """A copy in which some rows count one payment more; each such row is missed on either side."""
    rows = H.range_history_exact(tx(spark, d), windows=(6,))
    hit = (F.col("id") % 13 == 0) | (F.col("label") == 1)
    return V.compare_exact(rows, rows.withColumn("count_6", F.col("count_6") + hit.cast("int")))


@query(
    "v16_validate_results_faults",
    f"""WITH {SC}, f AS (SELECT * REPLACE (CASE WHEN seed = 43 AND cap = 0.05 THEN NULL ELSE precision END AS precision, CASE WHEN fold = 1 THEN alert_rate + 1 ELSE alert_rate END AS alert_rate,
    CASE WHEN model = 'PH' THEN -business_cost - 1 ELSE business_cost END AS business_cost, CASE WHEN fold = 2 AND seed = 42 THEN tp + 1 ELSE tp END AS tp,
    CASE WHEN fn_cost = 10 THEN pr_auc ELSE pr_auc / 2 END AS pr_auc, CASE WHEN model = 'PP' AND fold = 3 THEN -threshold - 1 ELSE threshold END AS threshold) FROM sc
  UNION ALL SELECT * FROM sc WHERE model = 'P0' AND fold = 3 AND cap = 0.03 AND fn_cost = 10 AND pr_auc > 0),
r AS (SELECT {KS}, cap, fn_cost, fp_cost, count(*) AS n FROM f GROUP BY ALL), s AS (SELECT {KS}, count(DISTINCT pr_auc) AS n FROM f GROUP BY ALL)
{_table({
    "nulls": _count("precision IS NULL"), "out_of_range": _count("NOT (alert_rate BETWEEN 0 AND 1) OR NOT (precision BETWEEN 0 AND 1) OR NOT (pr_auc BETWEEN 0 AND 1)"),
    "negative_cost": _count("business_cost < 0 OR all_normal_cost < 0"), "bad_threshold": _count("threshold < 0"),
    "cost_identity": _count("abs(business_cost - false_negative_cost - false_positive_cost) > 1e-8 + 1e-5 * (false_negative_cost + false_positive_cost)"),
    "confusion_total": _count("tp + fp + tn + fn <> rows"), "positive_total": _count("tp + fn <> positives"),
    "alert_rate": _count("abs(alert_rate - alert_count / rows::DOUBLE) > 1e-4"), "all_normal": _count("abs(all_normal_cost - positives * fn_cost) > 1e-3"),
    "repeated_key": _count("n > 1", "r"), "row_count": f"SELECT (count(*) <> {3 * len(SEEDS) * len(MODELS) * 4})::INTEGER FROM f", "ap_constant": _count("n > 1", "s"),
})}""",
)
def _(spark, d):
    good, c = scenarios(spark, d), F.col
    bad = good.withColumns({
        "precision": F.when((c("seed") == 43) & (c("cap") == 0.05), F.lit(None)).otherwise(c("precision")),
        "alert_rate": c("alert_rate") + (c("fold") == 1).cast("int"),
        "business_cost": F.when(c("model") == "PH", -c("business_cost") - 1).otherwise(c("business_cost")),
        "tp": c("tp") + ((c("fold") == 2) & (c("seed") == 42)).cast("int"),
        "pr_auc": F.when(c("fn_cost") == 10, c("pr_auc")).otherwise(c("pr_auc") / 2),
        "threshold": F.when((c("model") == "PP") & (c("fold") == 3), -c("threshold") - 1).otherwise(c("threshold")),
    })
    again = good.where("model = 'P0' AND fold = 3 AND cap = 0.03 AND fn_cost = 10 AND pr_auc > 0")
    return V.validate_results(bad.unionByName(again), ["model", *SCENARIO], 3 * len(SEEDS) * len(MODELS) * 4, K)


@query(
    "v17_validate_seed_grid_faults",
    f"""WITH {SC}, g AS (SELECT * FROM sc WHERE cap = 0.03 AND fn_cost = 100),
f AS (SELECT fold, model, CASE WHEN model = 'PP' AND seed = 44 AND fold = 3 THEN 99 ELSE seed END AS seed, positives + CAST(seed = 43 AND fold <> 2 AS INTEGER) AS positives FROM g WHERE NOT (model = 'PH' AND seed = 43)
  UNION ALL SELECT fold, model, seed, positives FROM g WHERE model = 'P0' AND seed = 42),
p AS (SELECT fold, model, count(DISTINCT seed) AS n, count(*) FILTER (seed NOT IN ({SEED_LIST})) AS x FROM f GROUP BY ALL), m AS (SELECT fold, count(DISTINCT positives) AS n FROM f GROUP BY ALL),
r AS (SELECT fold, model, seed, count(*) AS n FROM f GROUP BY ALL)
{_table({
    "incomplete": _count(f"n <> {len(SEEDS)}", "p"), "unknown_seed": "SELECT sum(x) FROM p", "scheme_count": f"SELECT (count(DISTINCT model) <> {len(MODELS) + 1})::INTEGER FROM f",
    "partition_moved": _count("n > 1", "m"), "repeated_key": _count("n > 1", "r"),
})}""",
)
def _(spark, d):
    grid = scenarios(spark, d).where("cap = 0.03 AND fn_cost = 100")
    bad = grid.where("NOT (model = 'PH' AND seed = 43)").withColumn("positives", F.col("positives") + ((F.col("seed") == 43) & (F.col("fold") != 2)).cast("int"))
    bad = bad.withColumn("seed", F.when((F.col("model") == "PP") & (F.col("seed") == 44) & (F.col("fold") == 3), 99).otherwise(F.col("seed")))
    bad = bad.unionByName(grid.where("model = 'P0' AND seed = 42"))
    return V.validate_seed_grid(bad, ["model"], SEEDS, len(MODELS) + 1, ["rows", "positives", "all_normal_cost"])


@query(
    "v18_validate_calibration_grid_faults",
    f"""WITH {LEDGER}, {profile_sql('raw', (0.03,))}, k AS (SELECT {KS}, max(alerts) AS alerts FROM pf GROUP BY ALL)
{_table({
    "methods_complete": "SELECT count(*) FROM k WHERE (fold = 2) <> (seed = 43)", "shared_raw_scores": "SELECT count(*) FROM k WHERE model = 'PH' AND EXISTS (SELECT 1 FROM ledger l WHERE l.fold = k.fold AND l.seed = k.seed AND l.model = k.model AND l.id % 7 = 0)",
    "capacity_exceeded": "SELECT count(*) FROM k WHERE model = 'PP'",
})}""",
)
def _(spark, d):
    """One method is missing in fold 2 and comes once more for a seed; one model saw other scores; one alerts too often."""
    rows = ledger(spark, d)
    profile = D.capacity_profile(rows, K, "raw", "label", [0.03])
    one = profile.select(*K, F.lit("raw").alias("method"))
    two = profile.select(*K, F.lit("platt").alias("method"))
    prints = V.fingerprint(rows, ["id", "raw"], K)
    moved = rows.withColumn("raw", F.col("raw") + ((F.col("model") == "PH") & (F.col("id") % 7 == 0)).cast("int"))
    over = profile.select((F.col("alerts") + (F.col("model") == "PP").cast("int")).alias("alerts"), F.ceil(F.col("rows") * F.lit(0.03)).alias("slots"))
    results = J.union_frames([one, two.where("fold <> 2"), two.where("seed = 43")])
    return V.validate_calibration_grid(results, K, ["raw", "platt"], prints.unionByName(V.fingerprint(moved, ["id", "raw"], K)), over)


@query(
    "v19_validate_replicates_faults",
    f"""WITH {DRAWS}, {reps_sql()}, {PAIRED}, g AS (SELECT fold, seed, block_length, contrast, count(*) AS n FROM pc WHERE NOT (fold = 1 AND replicate_id % 10 = 0) GROUP BY ALL)
{_table({
    "unpaired": "SELECT count(*) FROM pc WHERE NOT (fold = 1 AND replicate_id % 10 = 0) AND replicate_id % 7 = 0",
    "cost_identity": "SELECT count(*) FROM pc WHERE NOT (fold = 1 AND replicate_id % 10 = 0) AND seed = 44",
    "too_many_found": "SELECT count(*) FROM pc WHERE NOT (fold = 1 AND replicate_id % 10 = 0) AND contrast = 'pairs'",
    "replicate_count": _count(f"n <> {REPS}", "g"),
})}""",
)
def _(spark, d):
    c = F.col
    bad = _paired(spark, d).where("NOT (fold = 1 AND replicate_id % 10 = 0)").withColumns({
        "paired_ok": F.when(c("replicate_id") % 7 == 0, 0).otherwise(c("paired_ok")),
        "positives": F.when(c("contrast") == "pairs", c("delta_tp") - 1).otherwise(c("positives")),
        "cost_reduction": c("cost_reduction") + F.when(c("seed") == 44, 50.0 + F.abs(c("cost_reduction"))).otherwise(0.0),
    })
    return V.validate_replicates(bad, ["fold", "seed", "block_length", "contrast"], REPS)


@query(
    "v21_result_structure_audit_faults",
    f"""WITH {LEDGER}, {LEDGER_METRICS}, t AS (SELECT {KS}, count(*) AS n, sum(label) AS p FROM ledger WHERE NOT (model = 'PH' AND fold = 1) AND NOT (seed = 43 AND fold = 2 AND id % 5 = 0) GROUP BY ALL),
o AS (SELECT fold, count(DISTINCT (n, p)) AS k FROM t GROUP BY ALL)
{_table({
    "task_count": f"SELECT (count(*) <> {3 * len(MODELS) * len(SEEDS)})::INTEGER FROM t", "fold_population": _count("k > 1", "o"),
    "metric_match": f"SELECT count(*) FROM t FULL JOIN (SELECT {KS}, any_value(rows) AS rows, any_value(positives) AS positives FROM lm GROUP BY ALL) m USING ({KS}) WHERE n IS DISTINCT FROM rows OR p IS DISTINCT FROM positives",
})}""",
)
def _(spark, d):
    rows = ledger(spark, d).where("NOT (model = 'PH' AND fold = 1) AND NOT (seed = 43 AND fold = 2 AND id % 5 = 0)")
    return V.result_structure_audit(rows, metrics_grid(spark, d), K, 3, len(MODELS), len(SEEDS))


@query(
    "a08_leakage_audit_faults",
    f"""WITH {CARD}, f AS (SELECT *, card2 IS NOT NULL AS whole, min(t) OVER (PARTITION BY card1) = t AS first1, min(t) OVER (PARTITION BY card1, card2) = t AS first2 FROM card)
SELECT 'first_row_count_zero' AS "check", 'card' AS prefix, (SELECT count(*) FROM f WHERE first1 AND id % 2 = 0)::BIGINT AS violations UNION ALL
SELECT 'first_row_count_zero', 'combo', (SELECT count(*) FROM f WHERE whole AND first2 AND id % 2 = 0) UNION ALL
SELECT 'unavailable_is_null', 'combo', (SELECT count(*) FROM f WHERE NOT whole AND id % 2 = 0) UNION ALL
SELECT 'ids_unique', 'all', (SELECT count(*) FROM f WHERE id % 100 = 1)""",
)
def _(spark, d):
    """Counts that include the row itself, features where the entity is unknown, and repeated rows."""
    features = H.build_entity_features(card(spark, d), ENTITIES, category=None)
    leak = {f"{p}_count": F.when(F.col("id") % 2 == 0, F.coalesce(F.col(f"{p}_count"), F.lit(0)) + 1).otherwise(F.col(f"{p}_count")) for p in ("card", "combo")}
    bad = features.withColumns(leak)
    bad = bad.unionByName(bad.where("id % 100 = 1"))
    out = A.leakage_audit(bad, ENTITIES, "t", "id")
    return out.where("check IN ('first_row_count_zero', 'ids_unique') OR (check = 'unavailable_is_null' AND prefix = 'combo')")


@query(
    "a09_invariance_audit_faults",
    f"""WITH {TX} SELECT 'label_flip' AS test, count(*) AS rows, count(*) AS changed_rows FROM tx UNION ALL SELECT 'shuffle', count(*), 0 FROM tx UNION ALL SELECT 'future_append', count(*), count(*) FROM tx""",
)
def _(spark, d):
    """A build that leaks: it carries the label, and the last time of the whole table."""

    def leaky(rows):
        last = rows.agg(F.max("step").alias("last"))
        return rows.select("id", "label", F.col("label").alias("copied")).join(F.broadcast(last))

    return A.invariance_audit(tx(spark, d), leaky, "id", "step", "label")
