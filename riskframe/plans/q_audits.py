"""Queries over data audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import audits as A
from riskframe.operators import history as H
from riskframe.operators import splits as S
from riskframe.plans.canon import BOUNDS, CARD, TX, card, folds, table, tx
from riskframe.plans.q_scores import rounded
from riskframe.plans.registry import query

ENTITIES = {"card": ["card1"], "combo": ["card1", "card2"]}
COVER = "CAST(id IN (SELECT doc_id FROM labels) AS INTEGER)"


def placed(spark, d):
    rows = tx(spark, d)
    return S.apply_boundaries(rows, folds(rows))


PLACED = f"{TX}, {BOUNDS}, pl AS (SELECT tx.*, fold, split FROM tx JOIN bounds ON step BETWEEN start_time AND end_time)"
FEATURES = {"recipient": ["recipient"], "pair": ["recipient", "origin"]}
HIST = """hh AS (SELECT id, count(*) OVER (PARTITION BY recipient ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rc,
    count(*) OVER (PARTITION BY recipient, origin ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc FROM tx)"""


@query(
    "a01_join_coverage",
    """WITH m AS (SELECT CAST(d.doc_id IN (SELECT doc_id FROM labels) AS INTEGER) AS c FROM documents d)
SELECT count(*) AS rows, sum(c)::BIGINT AS covered_rows, sum(1 - c)::BIGINT AS missing_rows, round(avg(c), 6) AS coverage_rate, round(1 - avg(c), 6) AS missing_rate FROM m""",
)
def _(spark, d):
    return rounded(A.join_coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id"))


@query(
    "a02_temporal_distribution",
    f"""WITH {TX}, r AS (SELECT min(step) AS lo, max(step) AS hi FROM tx), b AS (SELECT *, CAST(greatest(1, least(10, ceil((step - lo) * 10 / (hi - lo)::DOUBLE))) AS INTEGER) AS time_bin,
  {COVER} AS c FROM tx, r)
SELECT time_bin, min(step) AS min_time, max(step) AS max_time, count(*) AS rows, sum(label)::BIGINT AS positives, round(avg(amount_cents) / 100, 6) AS amount_mean, sum(c)::BIGINT AS covered_rows,
  round(avg(label), 6) AS rate, round(avg(c), 6) AS coverage_rate, round(quantile_cont(amount_cents, 0.5) / 100, 6) AS amount_median FROM b GROUP BY 1""",
)
def _(spark, d):
    rows = A.mark_covered(tx(spark, d), table(spark, d, "labels").withColumnRenamed("doc_id", "id"), "id")
    return rounded(A.temporal_distribution(S.time_bins(rows, 10), "amount_cents", "label", "covered", "step"))


def _repeat_sql(name, cols):
    known = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return f"""SELECT '{name}' AS entity, any_value(w.rows) AS rows, any_value(w.v) AS valid_rows, round(any_value(1 - w.v / w.rows::DOUBLE), 6) AS missing_ratio, count(*) AS entities,
  round(avg(c), 6) AS mean_rows, max(c) AS max_rows, round(avg(CAST(c = 1 AS INTEGER)), 6) AS single_ratio, round(avg(CAST(c >= 2 AS INTEGER)), 6) AS ge2_ratio,
  round(avg(CAST(c >= 5 AS INTEGER)), 6) AS ge5_ratio, round(avg(CAST(c >= 10 AS INTEGER)), 6) AS ge10_ratio, round(avg(span), 6) AS span_mean,
  round(quantile_cont(c, 0.5), 6) AS median_rows, round(quantile_cont(c, 0.9), 6) AS p90_rows, round(quantile_cont(c, 0.95), 6) AS p95_rows,
  round(quantile_cont(span, 0.5), 6) AS span_median, round(quantile_cont(span, 0.9), 6) AS span_p90
FROM (SELECT count(*) AS c, max(t) - min(t) AS span FROM card WHERE {known} GROUP BY {", ".join(cols)}), (SELECT count(*) AS rows, count(*) FILTER ({known}) AS v FROM card) w"""


REPEAT = " UNION ALL ".join(_repeat_sql(n, c) for n, c in ENTITIES.items())


@query("a03_entity_repeatability", f"WITH {CARD} {REPEAT}")
def _(spark, d):
    return rounded(A.entity_repeatability(card(spark, d), ENTITIES, "t"))


SPLIT = {"train": (0, 1799999), "validation": (1800000, 2199999), "test": (2200000, 99999999)}
CARD_SPLIT = f"{CARD}, cs AS (SELECT *, CASE WHEN t < 1800000 THEN 'train' WHEN t < 2200000 THEN 'validation' ELSE 'test' END AS split FROM card)"


def _cover_sql(name, cols):
    known, key = " AND ".join(f"{c} IS NOT NULL" for c in cols), ", ".join(cols)
    return f"""SELECT '{name}' AS entity, split, count(*) AS future_rows, count(*) FILTER (NOT ({known})) AS missing_rows, count(*) FILTER ({known}) AS valid_rows,
  count(*) FILTER (({known}) AND s = 1) AS seen_rows, count(DISTINCT CASE WHEN {known} THEN concat_ws('|', {key}) END) AS unique_entities,
  count(DISTINCT CASE WHEN ({known}) AND s = 1 THEN concat_ws('|', {key}) END) AS seen_entities,
  round(count(*) FILTER (({known}) AND s = 1)::DOUBLE / count(*) FILTER ({known}), 6) AS seen_row_ratio,
  round(count(*) FILTER (({known}) AND s = 0)::DOUBLE / count(*) FILTER ({known}), 6) AS new_row_ratio,
  round(count(DISTINCT CASE WHEN ({known}) AND s = 1 THEN concat_ws('|', {key}) END)::DOUBLE / count(DISTINCT CASE WHEN {known} THEN concat_ws('|', {key}) END), 6) AS seen_entity_ratio
FROM (SELECT *, CAST(concat_ws('|', {key}) IN (SELECT concat_ws('|', {key}) FROM cs WHERE split = 'train' AND {known}) AS INTEGER) AS s FROM cs WHERE split <> 'train') GROUP BY split"""


COVERAGE = " UNION ALL ".join(_cover_sql(n, c) for n, c in ENTITIES.items())


def _card_split(spark, d):
    return S.fixed_splits(card(spark, d), SPLIT, "t")


@query("a04_entity_coverage", f"WITH {CARD_SPLIT} {COVERAGE}")
def _(spark, d):
    return rounded(A.entity_coverage(_card_split(spark, d), ENTITIES))


NEEDS = {"previous_count": 1, "previous_std": 2, "long_history": 10}


def _feasible_sql(name, cols):
    known, key = " AND ".join(f"{c} IS NOT NULL" for c in cols), ", ".join(cols)
    return f"""SELECT '{name}' AS entity, feature, required, count(*) AS valid_rows, count(*) FILTER (p >= required) AS sufficient_rows,
  round(count(*) FILTER (p >= required)::DOUBLE / count(*), 6) AS sufficient_ratio
FROM (SELECT count(*) OVER (PARTITION BY {key} ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM card WHERE {known}),
  (VALUES {", ".join(f"('{f}', {k})" for f, k in NEEDS.items())}) r(feature, required) GROUP BY ALL"""


FEASIBLE = " UNION ALL ".join(_feasible_sql(n, c) for n, c in ENTITIES.items())


@query("a05_history_feasibility", f"WITH {CARD} {FEASIBLE}")
def _(spark, d):
    return rounded(A.history_feasibility(card(spark, d), ENTITIES, "t", NEEDS))


@query(
    "a06_entity_recommendation",
    f"""WITH {CARD_SPLIT}, r AS ({REPEAT}), c AS ({COVERAGE}), f AS ({FEASIBLE}), s AS (SELECT r.entity, (1 - missing_ratio) * seen_row_ratio * sufficient_ratio AS p
  FROM r JOIN c ON c.entity = r.entity AND c.split = 'test' JOIN f ON f.entity = r.entity AND feature = 'previous_count')
SELECT arg_max(entity, (p, entity)) AS entity, round(max(p), 4) AS product FROM s""",
)
def _(spark, d):
    rows = _card_split(spark, d)
    out = A.entity_recommendation(
        A.entity_repeatability(rows, ENTITIES, "t"), A.entity_coverage(rows, ENTITIES), A.history_feasibility(rows, ENTITIES, "t", NEEDS), "previous_count"
    )
    return rounded(out, 4)


AVAILABLE = ["combo_count", "combo_mean", "combo_recency", "combo_has_history"]


@query(
    "a07_feature_availability",
    f"""WITH {CARD}, h AS (SELECT id, count(*) OVER w AS n, sum(amount_cents) OVER w AS s, max(t) OVER w AS prev FROM card WHERE card1 IS NOT NULL AND card2 IS NOT NULL
    WINDOW w AS (PARTITION BY card1, card2 ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT n::DOUBLE AS combo_count, s::DOUBLE / (100 * nullif(n, 0)) AS combo_mean, (t - prev)::DOUBLE AS combo_recency, CAST(coalesce(n, 0) >= 1 AS INTEGER)::DOUBLE AS combo_has_history
  FROM card LEFT JOIN h USING (id)), l AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v FROM e" for f in AVAILABLE)})
SELECT feature, count(*) AS rows, count(v) AS present, round(1 - count(v) / count(*)::DOUBLE, 6) AS missing_rate, round(avg(v), 6) AS mean, round(max(v), 6) AS max,
  round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95 FROM l GROUP BY feature""",
)
def _(spark, d):
    return rounded(A.feature_availability(H.entity_history(card(spark, d), ["card1", "card2"], "combo", category=None), AVAILABLE))


@query(
    "a08_leakage_audit",
    """SELECT * FROM (VALUES ('first_row_count_zero'), ('same_time_identical'), ('recency_positive'), ('unavailable_is_null')) a("check"), (VALUES ('card'), ('combo')) b(prefix), (SELECT 0::BIGINT AS violations)
UNION ALL SELECT 'ids_unique', 'all', 0""",
)
def _(spark, d):
    features = H.build_entity_features(card(spark, d), ENTITIES, category=None)
    return A.leakage_audit(features, ENTITIES, "t", "id")


@query(
    "a09_invariance_audit",
    """SELECT t AS test, (SELECT count(*) FROM events) AS rows, 0::BIGINT AS changed_rows FROM (VALUES ('label_flip'), ('shuffle'), ('future_append')) v(t)""",
)
def _(spark, d):
    return A.invariance_audit(tx(spark, d), lambda rows: H.range_history_exact(rows, windows=(6, 24)), "id", "step", "label")


@query(
    "a10_distribution_by_fold",
    f"""WITH {PLACED}, c AS (SELECT fold, split, type, count(*) AS n FROM pl GROUP BY ALL), w AS (SELECT fold, split, count(*) AS rows, round(avg(label), 6) AS rate, round(avg(amount_cents) / 100, 6) AS amount_mean,
  round(quantile_cont(amount_cents, 0.5) / 100, 6) AS amount_median, round(quantile_cont(amount_cents, 0.9) / 100, 6) AS amount_p90 FROM pl GROUP BY fold, split)
SELECT w.*, type AS category, n AS found_count, round(n / w.rows::DOUBLE, 6) AS found_ratio FROM w JOIN c USING (fold, split)""",
)
def _(spark, d):
    out = rounded(A.distribution_by_fold(placed(spark, d), "amount_cents", "type"))
    parsed = F.from_json("composition", "map<string,struct<count:bigint,ratio:double>>")
    long = out.select("*", F.explode(parsed).alias("category", "v")).drop("composition")
    return long.withColumns({"found_count": F.col("v.count"), "found_ratio": F.col("v.ratio")}).drop("v")


def _with_history(spark, d):
    rows = tx(spark, d)
    features = H.build_entity_features(rows, FEATURES, time="step", category=None)
    return S.apply_boundaries(features, folds(rows))


AVAIL = f"""{PLACED}, {HIST}, lg AS (SELECT fold, split, 'recipient' AS entity, rc AS c FROM pl JOIN hh USING (id) UNION ALL SELECT fold, split, 'pair', pc FROM pl JOIN hh USING (id)),
av AS (SELECT fold, split, entity, count(*) AS rows, count(*) AS available_rows, count(*) FILTER (c > 0) AS has_history_rows, count(*) FILTER (c = 0) AS no_history_rows, 1::DOUBLE AS availability_rate,
  round(avg(CAST(c > 0 AS INTEGER)), 6) AS has_history_ratio, round(avg(CAST(c = 0 AS INTEGER)), 6) AS no_history_ratio FROM lg GROUP BY ALL)"""


@query("a11_history_availability_by_fold", f"WITH {AVAIL} SELECT * FROM av")
def _(spark, d):
    return rounded(A.history_availability_by_fold(_with_history(spark, d), list(FEATURES)))


@query(
    "a12_cold_start",
    f"""WITH {AVAIL} SELECT fold, split, entity, rows, available_rows, no_history_rows AS first_seen_rows, no_history_ratio AS first_seen_ratio FROM av WHERE split IN ('validation', 'test')""",
)
def _(spark, d):
    return rounded(A.cold_start(A.history_availability_by_fold(_with_history(spark, d), list(FEATURES))))


@query(
    "a13_pair_repetition",
    f"""WITH {TX}, p AS (SELECT origin, recipient, count(*) AS f FROM tx GROUP BY ALL)
SELECT sum(f)::BIGINT AS rows, count(*) AS pairs, count(*) FILTER (f >= 2) AS repeated_pairs, coalesce(sum(f) FILTER (f >= 2), 0)::BIGINT AS rows_in_repeated, max(f) AS max_frequency,
  round(avg(f), 6) AS mean_frequency, count(*) FILTER (f >= 3) AS pairs_ge_3, count(*) FILTER (f >= 5) AS pairs_ge_5, count(*) FILTER (f >= 10) AS pairs_ge_10,
  quantile_cont(f, 0.5) AS median_frequency, quantile_cont(f, 0.9) AS p90_frequency, round(quantile_cont(f, 0.99), 6) AS p99_frequency, count(DISTINCT origin) AS unique_a, count(DISTINCT recipient) AS unique_b,
  round(count(*) FILTER (f >= 2)::DOUBLE / count(*), 6) AS repeated_pair_share, round(coalesce(sum(f) FILTER (f >= 2), 0)::DOUBLE / sum(f), 6) AS repeated_row_share FROM p""",
)
def _(spark, d):
    return rounded(A.pair_repetition(tx(spark, d), "origin", "recipient"))


@query(
    "a14_feature_distribution",
    f"""WITH {PLACED}, h AS (SELECT id, count(*) OVER (PARTITION BY recipient, origin ORDER BY step RANGE BETWEEN 240 PRECEDING AND 1 PRECEDING) AS pair_240,
    count(*) OVER (PARTITION BY recipient ORDER BY step RANGE BETWEEN 240 PRECEDING AND 1 PRECEDING) AS count_240 FROM tx),
l AS (SELECT fold, split, 'pair_240' AS feature, pair_240::DOUBLE AS v FROM pl JOIN h USING (id) UNION ALL SELECT fold, split, 'count_240', count_240::DOUBLE FROM pl JOIN h USING (id))
SELECT fold, split, feature, count(*) AS rows, count(*) - count(v) AS missing, count(*) FILTER (v = 0) AS zero_rows, count(*) FILTER (v = 1) AS one_rows, count(*) FILTER (v > 1) AS above_one_rows,
  count(DISTINCT v) AS unique_values, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(count(*) FILTER (v = 0)::DOUBLE / count(v), 6) AS zero_rate,
  round(count(*) FILTER (v = 1)::DOUBLE / count(v), 6) AS probability_one, round(count(*) FILTER (v > 1)::DOUBLE / count(v), 6) AS probability_above_one, 0::DOUBLE AS missing_rate,
  round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.99), 6) AS p99 FROM l GROUP BY fold, split, feature""",
)
def _(spark, d):
    rows = tx(spark, d)
    pairs = H.past_count(rows, ["recipient", "origin"], "step", 240).withColumnRenamed("count_240", "pair_240")
    features = H.past_count(pairs, ["recipient"], "step", 240).select("id", "step", "pair_240", "count_240")
    return rounded(A.feature_distribution(S.apply_boundaries(features, folds(rows)), ["pair_240", "count_240"]))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "a16_partition_profile",
    f"""WITH {PLACED} SELECT fold, split, count(*) AS rows, sum(label)::BIGINT AS positives, round(avg(label), 6) AS rate, round(avg(amount_cents) / 100, 6) AS amount_mean,
  round(stddev_pop(amount_cents) / 100, 6) AS amount_std, round(avg(amount_cents) FILTER (label = 1) / 100, 6) AS amount_mean_positive, round(avg(amount_cents) FILTER (label = 0) / 100, 6) AS amount_mean_negative,
  {", ".join(f"round(count(*) FILTER (type = '{t}')::DOUBLE / count(*), 6) AS share_{t}, round(count(*) FILTER (type = '{t}' AND label = 1)::DOUBLE / sum(label), 6) AS share_positive_{t}" for t in TYPES)}
FROM pl GROUP BY fold, split""",
)
def _(spark, d):
    return rounded(A.partition_profile(placed(spark, d), "amount_cents", "type", TYPES))


@query(
    "a17_split_profile",
    f"""WITH {PLACED} SELECT fold, split, count(*) AS rows, sum(label)::BIGINT AS positives, round(avg(label), 6) AS rate, min(step) AS min_time, max(step) AS max_time, count(DISTINCT step) AS times,
  round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY fold), 6) AS fraction FROM pl GROUP BY fold, split""",
)
def _(spark, d):
    return rounded(A.split_profile(placed(spark, d)))
