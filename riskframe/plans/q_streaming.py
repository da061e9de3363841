"""Queries over Structured Streaming (X01-X05), replayed from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions.scalars import hash_draw
from riskframe.plans.canon import table
from riskframe.plans.q_scores import listed, rates_sql, rounded
from riskframe.plans.registry import query
from riskframe.session import scratch_path
from riskframe.streaming import operators as X
from riskframe.streaming.learner import replay_online
from riskframe.streaming.replay import BY_KEY, replay


def _scored(spark, d):
    e = table(spark, d, "events")
    raw = (hash_draw(F.lit("live"), F.col("event_id")) % 1000).cast("double") / F.lit(1000.0)
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("entity"),
        F.get_json_object("props", "$.k").cast("bigint").alias("origin"), F.round(F.col("value") * 100).cast("bigint").alias("amount_cents"),
        (F.col("event_type") == "error").cast("int").alias("label"), raw.alias("raw"), (raw >= 0.9).cast("int").alias("alert"),
    )


SCORED = """sc AS (SELECT event_id AS id, ts, user_id AS entity, CAST(event_type = 'error' AS INTEGER) AS label, epoch(date_trunc('hour', ts))::BIGINT // 3600 AS hour,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS origin, CAST(round(value * 100) AS BIGINT) AS amount_cents,
    ('0x' || substr(sha256(concat_ws('|', 'live', event_id)), 1, 8))::BIGINT % 1000 / 1000::DOUBLE AS raw FROM events)"""

DAYS = f"""{SCORED}, dy AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS rows, count(*) FILTER (id % 10 <> 0 AND label = 1 AND raw >= 0.5) AS tp,
    count(*) FILTER (id % 10 <> 0 AND label = 0 AND raw >= 0.5) AS fp, count(*) FILTER (id % 10 <> 0 AND label = 1 AND raw < 0.5) AS fn,
    count(*) FILTER (id % 10 <> 0 AND label = 0 AND raw < 0.5) AS tn, count(*) FILTER (id % 10 = 0) AS unlabelled FROM sc GROUP BY 1)"""


def _delayed(spark, d):
    rows = _scored(spark, d)
    labels = rows.where("id % 10 <> 0").select("id", (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("label_ts"), "label")
    return replay(
        spark,
        {"scores": (rows.select("id", "ts", "raw"), "ts"), "labels": (labels, "label_ts")},
        lambda s: X.delayed_label_eval(s["scores"], s["labels"], "id", "ts", "label_ts", "raw", "label", "24 HOURS"),
        "delayed",
    )


@query("x01_delayed_label_eval", f"WITH {DAYS} SELECT epoch(start)::BIGINT AS start, rows, tp, fp, fn, tn, unlabelled FROM dy")
def _(spark, d):
    return _delayed(spark, d).withColumn("start", F.unix_seconds("start"))


@query(
    "x03_online_baseline",
    f"WITH {DAYS} SELECT epoch(start)::BIGINT AS start, rows, tp, fp, fn, tn, unlabelled, {listed(rates_sql(10, 1))} FROM dy",
)
def _(spark, d):
    return rounded(X.report(_delayed(spark, d)).withColumn("start", F.unix_seconds("start")))


RATE, PERIOD = 0.5, 86_400
# Labels of nine rows in ten arrive 1 to 48 hours after the row.
LEARNER = f"""{SCORED}, fe AS (SELECT id, epoch(date_trunc('second', ts))::BIGINT // {PERIOD} AS period, (epoch(date_trunc('second', ts))::BIGINT + 3600 * (1 + id % 48)) // {PERIOD} AS arrives,
    id % 10 <> 0 AS labelled, label::DOUBLE AS y, ln(1 + amount_cents / 100::DOUBLE) / 5 AS x1, (hour % 24) / 24::DOUBLE AS x2 FROM sc),
pe AS (SELECT period, row_number() OVER (ORDER BY period) AS k FROM (SELECT period FROM fe UNION SELECT arrives FROM fe WHERE labelled)),
w AS (SELECT 1::BIGINT AS k, 0::DOUBLE AS b, 0::DOUBLE AS b1, 0::DOUBLE AS b2
  UNION ALL SELECT w.k + 1, any_value(w.b) - {RATE} * coalesce(avg(1 / (1 + exp(-(w.b + w.b1 * x1 + w.b2 * x2))) - y), 0),
    any_value(w.b1) - {RATE} * coalesce(avg((1 / (1 + exp(-(w.b + w.b1 * x1 + w.b2 * x2))) - y) * x1), 0),
    any_value(w.b2) - {RATE} * coalesce(avg((1 / (1 + exp(-(w.b + w.b1 * x1 + w.b2 * x2))) - y) * x2), 0)
  FROM w JOIN pe ON pe.k = w.k LEFT JOIN fe ON fe.arrives = pe.period AND labelled GROUP BY w.k)"""


@query(
    "x03_online_learner",
    f"""WITH RECURSIVE {LEARNER} SELECT id, fe.period, round(1 / (1 + exp(-(b + b1 * x1 + b2 * x2))), 6) AS raw FROM fe JOIN pe ON pe.period = fe.period JOIN w ON w.k = pe.k""",
)
def _(spark, d):
    """Every row scored by the model that the labels of earlier days have made."""
    rows = _scored(spark, d)
    hour = F.floor(F.unix_seconds("ts") / 3600)
    asked = rows.select("id", "ts", (F.ln(1 + F.col("amount_cents") / 100) / 5).alias("x1"), (hour % 24 / 24).alias("x2"))
    delay = F.make_dt_interval(F.lit(0), (1 + F.col("id") % 48).cast("int"))
    labels = rows.where("id % 10 <> 0").select("id", (F.col("ts") + delay).alias("label_ts"), "label")
    learner = replay_online(spark, scratch_path(spark, "learner"), (asked, "ts"), (labels, "label_ts"), ["x1", "x2"], "id", "label", PERIOD, RATE)
    return rounded(learner.scored().select("id", "period", "raw"))


@query(
    "x02_drift_monitor",
    f"""WITH RECURSIVE {SCORED}, b AS (SELECT entity % 8 AS key, epoch(ts)::BIGINT // 21600 * 21600 AS start, count(*) AS rows,
    sum(CASE WHEN label = 1 AND raw < 0.5 THEN 10 WHEN label = 0 AND raw >= 0.5 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS x FROM (SELECT * REPLACE (floor(epoch(ts)) AS ts) FROM (SELECT * FROM sc))
  GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start) AS k FROM b),
r AS (SELECT key, start, rows, x, k, x AS f, x AS s, greatest(0.5::DOUBLE, 0.5 * 0.98) AS alpha, 0 AS drift FROM i WHERE k = 1
  UNION ALL SELECT key, start, rows, x, k, f, s, CASE WHEN dr THEN 0.85 ELSE greatest(0.5::DOUBLE, alpha * 0.98) END, dr::INTEGER FROM (
    SELECT i.key, i.start, i.rows, i.x, i.k, r.f + 0.3::DOUBLE * (i.x - r.f) AS f, r.s + 0.03::DOUBLE * (i.x - r.s) AS s, r.alpha,
      i.k > 8 AND abs(r.f + 0.3::DOUBLE * (i.x - r.f) - (r.s + 0.03::DOUBLE * (i.x - r.s))) > 0.5::DOUBLE * (r.s + 0.03::DOUBLE * (i.x - r.s)) AS dr
    FROM r JOIN i ON i.key = r.key AND i.k = r.k + 1))
SELECT key, start, rows, round(x, 6) AS mean_cost, round(f, 6) AS fast, round(s, 6) AS slow, round(alpha, 6) AS alpha, drift FROM r""".replace(
        "epoch(ts)::BIGINT // 21600 * 21600 AS start, count(*) AS rows", "ts::BIGINT // 21600 * 21600 AS start, count(*) AS rows"
    ),
)
def _(spark, d):
    rows = _scored(spark, d).withColumn("key", F.col("entity") % 8)
    out = X.two_stage(spark, rows, "ts", lambda s: X.cost_buckets(s, "key", "ts", "label", "raw"), X.drift_monitor, "drift")
    return rounded(out.withColumn("start", F.unix_seconds("start")))


def _live_sql():
    parts, outs = [], []
    for w in (1, 6, 24):
        over = f"OVER (PARTITION BY entity ORDER BY hour RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        parts.append(f"count(*) {over} AS n{w}, sum(amount_cents) {over} AS s{w}, sum(amount_cents::HUGEINT * amount_cents) {over} AS ss{w}, max(amount_cents) {over} AS mx{w}, count(DISTINCT origin) {over} AS d{w}")
        outs.append(f"""n{w} AS count_{w}, round(CASE WHEN n{w} > 0 THEN s{w}::DOUBLE / (100.0::DOUBLE * n{w}) ELSE 0 END, 6) AS mean_{w}, coalesce(mx{w} / 100::DOUBLE, 0) AS max_{w},
    round(CASE WHEN n{w} > 1 THEN sqrt((n{w} * ss{w} - s{w} * s{w})::DOUBLE / (n{w}::DOUBLE * (n{w} - 1)::DOUBLE)) / 100 ELSE 0 END, 6) AS std_{w}, d{w} AS distinct_{w}""")
    return f"""WITH {SCORED}, w AS (SELECT *, {", ".join(parts)}, max(hour) OVER (PARTITION BY entity ORDER BY hour RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM sc)
SELECT DISTINCT entity, hour, coalesce(hour - prev, -1) AS recency, {", ".join(outs)} FROM w"""


@query("x04_streaming_history", _live_sql())
def _(spark, d):
    rows = _scored(spark, d).select("ts", "entity", "origin", "amount_cents")
    partials = X.two_stage(
        spark, rows, "ts", lambda s: X.history_buckets(s, "entity", "origin", "ts", "amount_cents", shards=2), X.streaming_history, "history",
        store=BY_KEY,
    )
    return rounded(X.combine_shards(partials))


@query(
    "x05_windowed_alerts_tumbling",
    f"""WITH {SCORED} SELECT epoch(date_trunc('day', ts))::BIGINT AS start, epoch(date_trunc('day', ts))::BIGINT + 86400 AS "end", count(*) AS rows, sum(label)::BIGINT AS positives,
  count(*) FILTER (raw >= 0.9) AS alerts, count(*) FILTER (raw >= 0.9 AND label = 1) AS captured FROM sc GROUP BY ALL""",
)
def _(spark, d):
    out = replay(spark, {"rows": (_scored(spark, d), "ts")}, lambda s: X.windowed_alerts(s["rows"], "ts", "label", "alert"), "alerts")
    return out.withColumns({"start": F.unix_seconds("start"), "end": F.unix_seconds("end")})


@query(
    "x05_windowed_alerts_sliding",
    f"""WITH {SCORED} SELECT (hour // 6 - k) * 21600 AS start, (hour // 6 - k) * 21600 + 86400 AS "end", count(*) AS rows, sum(label)::BIGINT AS positives,
  count(*) FILTER (raw >= 0.9) AS alerts, count(*) FILTER (raw >= 0.9 AND label = 1) AS captured FROM sc, (VALUES (0), (1), (2), (3)) o(k) GROUP BY ALL""",
)
def _(spark, d):
    out = replay(
        spark, {"rows": (_scored(spark, d), "ts")}, lambda s: X.windowed_alerts(s["rows"], "ts", "label", "alert", "24 hours", "6 hours"), "sliding"
    )
    return out.withColumns({"start": F.unix_seconds("start"), "end": F.unix_seconds("end")})


@query(
    "x05_windowed_alerts_unlabelled",
    f"""WITH {SCORED}, half AS (SELECT * REPLACE (CASE WHEN origin % 3 <> 0 THEN label END AS label) FROM sc)
SELECT epoch(date_trunc('day', ts))::BIGINT AS start, epoch(date_trunc('day', ts))::BIGINT + 86400 AS "end", count(*) AS rows, sum(label)::BIGINT AS positives,
  count(*) FILTER (raw >= 0.9) AS alerts, count(*) FILTER (raw >= 0.9 AND label = 1) AS captured FROM half GROUP BY ALL""",
)
def _(spark, d):
    """Labels that have not come yet: their rows and alerts count."""
    rows = _scored(spark, d).withColumn("label", F.when(F.col("origin") % 3 != 0, F.col("label")))
    out = replay(spark, {"rows": (rows, "ts")}, lambda s: X.windowed_alerts(s["rows"], "ts", "label", "alert"), "unlabelled")
    return out.withColumns({"start": F.unix_seconds("start"), "end": F.unix_seconds("end")})
