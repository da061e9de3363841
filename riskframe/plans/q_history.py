"""Queries over strictly-past history."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import history as H
from riskframe.plans.canon import CARD, PAYMENT, SHOP, TX, card, shop, shop_id, shop_parts, tx
from riskframe.plans.registry import query

R24 = "OVER (PARTITION BY recipient ORDER BY step RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING)"


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


@query("f01_past_count", f"WITH {TX} SELECT id, count(*) {R24} AS count_24 FROM tx")
def _(spark, d):
    return H.past_count(tx(spark, d), ["recipient"], "step", 24).select("id", "count_24")


@query(
    "f02_past_mean",
    f"""WITH {TX}, w AS (SELECT id, count(*) {R24} AS n, sum(amount_cents) {R24} AS s FROM tx)
SELECT id, round(CASE WHEN n > 0 THEN s::DOUBLE / (100.0::DOUBLE * n) ELSE 0 END, 6) AS mean_24 FROM w""",
)
def _(spark, d):
    out = H.past_mean(tx(spark, d), ["recipient"], "step", "amount_cents", 24)
    return _rounded(out, "mean_24").select("id", "mean_24")


@query("f03_past_max", f"WITH {TX} SELECT id, coalesce(max(amount_cents) {R24} / 100::DOUBLE, 0) AS max_24 FROM tx")
def _(spark, d):
    return H.past_max(tx(spark, d), ["recipient"], "step", "amount_cents", 24).select("id", "max_24")


@query(
    "f04_past_std",
    f"""WITH {TX}, w AS (SELECT id, count(*) {R24} AS n, sum(amount_cents) {R24} AS s,
    sum(amount_cents::HUGEINT * amount_cents) {R24} AS ss FROM tx)
SELECT id, round(CASE WHEN n > 1 THEN sqrt((n * ss - s * s)::DOUBLE / (n::DOUBLE * (n - 1)::DOUBLE)) / 100 ELSE 0 END, 6)
  AS std_24 FROM w""",
)
def _(spark, d):
    out = H.past_std(tx(spark, d), ["recipient"], "step", "amount_cents", 24)
    return _rounded(out, "std_24").select("id", "std_24")


@query("f05_past_distinct", f"WITH {TX} SELECT id, count(DISTINCT origin) {R24} AS distinct_24 FROM tx")
def _(spark, d):
    return H.past_distinct(tx(spark, d), ["recipient"], ["origin"], "step", 24).select("id", "distinct_24")


@query(
    "f06_past_pair_count",
    f"""WITH {TX} SELECT id, count(*) OVER (PARTITION BY recipient, origin ORDER BY step
  RANGE BETWEEN 240 PRECEDING AND 1 PRECEDING) AS count_240 FROM tx""",
)
def _(spark, d):
    return H.past_count(tx(spark, d), ["recipient", "origin"], "step", 240).select("id", "count_240")


@query(
    "f07_recency",
    f"""WITH {TX} SELECT id, coalesce(step - max(step) OVER (PARTITION BY recipient ORDER BY step
  RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)::BIGINT AS recency FROM tx""",
)
def _(spark, d):
    return H.recency(tx(spark, d), ["recipient"], "step").select("id", "recency")


def _exact_sql(windows, ratio):
    parts, outs = [], []
    for w in windows:
        frame = f"ORDER BY step RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING"
        over = f"OVER (PARTITION BY recipient {frame})"
        parts.append(
            f"""count(*) {over} AS n{w}, sum(amount_cents) {over} AS s{w},
    sum(amount_cents::HUGEINT * amount_cents) {over} AS ss{w}, max(amount_cents) {over} AS mx{w},
    count(DISTINCT origin) {over} AS d{w}, count(*) OVER (PARTITION BY recipient, origin {frame}) AS p{w}"""
        )
        mean = f"(CASE WHEN n{w} > 0 THEN s{w}::DOUBLE / (100.0::DOUBLE * n{w}) ELSE 0 END)"
        quotient = (
            f"coalesce(amount_cents / 100::DOUBLE / nullif({mean}, 0), 0)"
            if ratio == "zero"
            else f"amount_cents / 100::DOUBLE / ({mean} + 1e-6::DOUBLE)"
        )
        outs.append(
            f"""n{w} AS count_{w}, round({mean}, 6) AS mean_{w}, coalesce(mx{w} / 100::DOUBLE, 0) AS max_{w},
    round(CASE WHEN n{w} > 1 THEN sqrt((n{w} * ss{w} - s{w} * s{w})::DOUBLE / (n{w}::DOUBLE * (n{w} - 1)::DOUBLE)) / 100
      ELSE 0 END, 6) AS std_{w}, d{w} AS distinct_{w}, p{w} AS pair_{w}, round({quotient}, 6) AS ratio_{w}"""
        )
    return f"""WITH {TX}, w AS (SELECT *, {", ".join(parts)},
    max(step) OVER (PARTITION BY recipient ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM tx)
SELECT id, step, recipient, origin, type, amount_cents, label, (step - 1) % 24 AS hour_of_day,
  CAST(floor((step - 1) / 24) AS INTEGER) AS day_index, coalesce(step - prev, -1) AS recency, {", ".join(outs)} FROM w"""


def _history(spark, d, fn):
    out = fn(tx(spark, d), windows=(1, 6, 24))
    return _rounded(out, *[f"{c}_{w}" for c in ("mean", "std", "ratio") for w in (1, 6, 24)])


@query("f08_range_history", _exact_sql((1, 6, 24), "offset"))
def _(spark, d):
    return _history(spark, d, H.range_history)


@query("f09_range_history_exact", _exact_sql((1, 6, 24), "zero"))
def _(spark, d):
    return _history(spark, d, H.range_history_exact)


def _entity_sql(entity, prefix, source="card", cte=CARD):
    cols = ", ".join(entity)
    known = " AND ".join(f"{c} IS NOT NULL" for c in entity)
    on = " AND ".join(f"f.{c} = r.{c}" for c in entity)
    over = f"OVER (PARTITION BY {cols} ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""h_{prefix} AS (SELECT id, count(*) {over} AS n, sum(amount_cents) {over} AS s,
    sum(amount_cents::HUGEINT * amount_cents) {over} AS ss, max(t) {over} AS prev,
    count(DISTINCT category) {over} AS dc FROM {source} WHERE {known}),
e_{prefix} AS (SELECT c.id, CAST({known} AS INTEGER) AS {prefix}_available, n AS {prefix}_count,
    round(s::DOUBLE / (100::DOUBLE * nullif(n, 0)), 6) AS {prefix}_mean,
    round(CASE WHEN n > 1 THEN sqrt((n * ss - s * s)::DOUBLE / (n::DOUBLE * (n - 1)::DOUBLE)) / 100 END, 6) AS {prefix}_std,
    round(amount_cents / 100::DOUBLE / (s::DOUBLE / (100::DOUBLE * nullif(n, 0)) + 1e-6::DOUBLE), 6) AS {prefix}_ratio,
    t - prev AS {prefix}_recency, dc AS {prefix}_distinct,
    CAST(coalesce(n, 0) >= 1 AS INTEGER) AS {prefix}_has_history, CAST(coalesce(n, 0) >= 2 AS INTEGER) AS {prefix}_has_std
  FROM {source} c LEFT JOIN h_{prefix} h ON h.id = c.id)"""


def _entity(df, prefix):
    return _rounded(df, f"{prefix}_mean", f"{prefix}_std", f"{prefix}_ratio")


@query("f10_entity_history", f"WITH {CARD}, {_entity_sql(['card1', 'card2'], 'combo')} SELECT * FROM e_combo")
def _(spark, d):
    out = H.entity_history(card(spark, d), ["card1", "card2"], "combo")
    return _entity(out, "combo").drop("t", "card1", "card2", "category", "amount_cents", "label")


@query(
    "f11_prior_distinct",
    f"""WITH {CARD} SELECT id, CASE WHEN card1 IS NOT NULL THEN count(DISTINCT category) OVER (PARTITION BY card1 ORDER BY t
  RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS prior_distinct FROM card""",
)
def _(spark, d):
    return H.prior_distinct(card(spark, d), ["card1"], "category", "t").select("id", "prior_distinct")


@query(
    "f12_history_flags",
    f"""WITH {CARD}, {_entity_sql(['card1', 'card2'], 'combo')}
SELECT combo_available AS available, combo_has_history AS has_history, combo_has_std AS has_std, count(*) AS rows
FROM e_combo GROUP BY ALL""",
)
def _(spark, d):
    out = H.entity_history(card(spark, d), ["card1", "card2"], "combo", category=None)
    return out.groupBy(
        F.col("combo_available").alias("available"),
        F.col("combo_has_history").alias("has_history"),
        F.col("combo_has_std").alias("has_std"),
    ).agg(F.count("*").alias("rows"))


@query(
    "f13_build_entity_features",
    f"""WITH {CARD}, {_entity_sql(['card1'], 'card')}, {_entity_sql(['card1', 'card2'], 'combo')}
SELECT c.id, c.label, a.* EXCLUDE (id), b.* EXCLUDE (id) FROM card c JOIN e_card a USING (id) JOIN e_combo b USING (id)""",
)
def _(spark, d):
    out = H.build_entity_features(card(spark, d), {"card": ["card1"], "combo": ["card1", "card2"]})
    return _entity(_entity(out, "card"), "combo").drop("t", "card1", "card2", "category", "amount_cents")


def _shop_sql(mode):
    parts, outs = [], []
    for w in (1, 7, 30):
        r = min(w, 7) if mode == "HS" else w
        over = f"OVER (PARTITION BY merchant ORDER BY step RANGE BETWEEN {r} PRECEDING AND 1 PRECEDING)"
        parts.append(
            f"""count(*) {over} AS n{w}, sum(amount_cents) {over} AS s{w},
    sum(amount_cents::HUGEINT * amount_cents) {over} AS ss{w}, max(amount_cents) {over} AS mx{w},
    count(DISTINCT customer) {over} AS d{w}"""
        )
        mean = f"(CASE WHEN n{w} > 0 THEN s{w}::DOUBLE / (100.0::DOUBLE * n{w}) ELSE 0 END)"
        outs.append(
            f"""n{w} AS h{w}_count, d{w} AS h{w}_customers, round({mean}, 6) AS h{w}_mean,
    coalesce(mx{w} / 100::DOUBLE, 0) AS h{w}_max,
    round(CASE WHEN n{w} > 1 THEN sqrt((n{w} * ss{w} - s{w} * s{w})::DOUBLE / (n{w}::DOUBLE * (n{w} - 1)::DOUBLE)) / 100
      ELSE 0 END, 6) AS h{w}_std, round(coalesce(amount_cents / 100::DOUBLE / nullif({mean}, 0), 0), 6) AS h{w}_ratio"""
        )
    past = "7" if mode == "HS" else "UNBOUNDED"
    return f"""WITH {SHOP}, w AS (SELECT *, {", ".join(parts)}, max(step) OVER (PARTITION BY merchant ORDER BY step
    RANGE BETWEEN {past} PRECEDING AND 1 PRECEDING) AS prev FROM shop)
SELECT id, {", ".join(outs)}, coalesce(step - prev, -1) AS recency, CAST(prev IS NOT NULL AS INTEGER) AS recency_available FROM w"""


def _shop(spark, d, mode):
    out = H.merchant_history(shop_parts(spark, d).drop("label"), mode=mode)
    out = _rounded(out, *[f"h{w}_{c}" for c in ("mean", "std", "ratio") for w in (1, 7, 30)])
    return out.select(shop_id().alias("id"), *out.columns).drop(*PAYMENT, "step", "merchant", "customer", "amount_cents")


@query("f14_merchant_history", _shop_sql("HL"))
def _(spark, d):
    return _shop(spark, d, "HL")


@query("f15_history_mode_short", _shop_sql("HS"))
def _(spark, d):
    return _shop(spark, d, "HS")


@query("f15_history_mode_none", f"WITH {SHOP} SELECT * FROM shop")
def _(spark, d):
    return H.merchant_history(shop(spark, d), mode="H0")


@query(
    "f16_history_provenance",
    f"""WITH {SHOP} SELECT a.id, a.merchant, a.step, b.id AS used_id, b.step AS used_time
FROM shop a JOIN shop b ON a.merchant = b.merchant AND b.step BETWEEN a.step - 7 AND a.step - 1""",
)
def _(spark, d):
    return H.history_provenance(shop(spark, d))


@query(
    "f16_provenance_summary",
    f"""WITH {SHOP} SELECT id, merchant, step, count(*) {{o}} AS used, min(id) {{o}} AS first_used, max(id) {{o}} AS last_used
FROM shop""".format(o="OVER (PARTITION BY merchant ORDER BY step RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)"),
)
def _(spark, d):
    return H.provenance_summary(shop(spark, d))


@query(
    "p01_calendar",
    f"""WITH {TX} SELECT id, (step - 1) % 24 AS hour_of_day, CAST(floor((step - 1) / 24) AS INTEGER) AS day_index FROM tx""",
)
def _(spark, d):
    from riskframe.functions.scalars import day_index, hour_of_day

    return tx(spark, d).select("id", hour_of_day(F.col("step")).alias("hour_of_day"), day_index(F.col("step")).alias("day_index"))
