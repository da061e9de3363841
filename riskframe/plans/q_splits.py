"""Queries over temporal splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import splits as S
from riskframe.plans.canon import BOUNDS, SHOP, TX, folds, shop, tx
from riskframe.plans.registry import query

GRID = """g0 AS (SELECT step, count(*) AS n, sum(label) AS pos FROM tx GROUP BY 1),
g AS (SELECT step, n, pos, row_number() OVER (ORDER BY step) AS i, sum(n) OVER (ORDER BY step) AS cum,
    sum(pos) OVER (ORDER BY step) AS cpos, sum(n) OVER () AS total, sum(pos) OVER () AS tpos, count(*) OVER () AS k FROM g0)"""


@query(
    "t01_nearest_boundary",
    f"""WITH {TX}, {GRID}, b AS (SELECT arg_min(i, (abs(cum - total * 0.7::DOUBLE), i)) AS pick FROM g WHERE i BETWEEN 1 AND k - 2)
SELECT i AS position, step AS last_time, cum::BIGINT AS cum_rows FROM g, b WHERE i = pick""",
)
def _(spark, d):
    return S.nearest_boundary(tx(spark, d), "step", 0.7, 1, 2)


@query(
    "t02_split_row_fraction",
    f"""WITH {TX}, {GRID}, a AS (SELECT arg_min(i, (abs(cum - total * 0.6::DOUBLE), i)) AS ia FROM g WHERE i BETWEEN 1 AND k - 2),
b AS (SELECT ia, arg_min(i, (abs(cum - total * {0.6 + 0.2!r}::DOUBLE), i)) AS ib FROM g, a WHERE i BETWEEN ia + 1 AND k - 1 GROUP BY ia)
SELECT id, CASE WHEN i <= ia THEN 'train' WHEN i <= ib THEN 'validation' ELSE 'test' END AS split FROM tx JOIN g USING (step), b""",
)
def _(spark, d):
    return S.temporal_split(tx(spark, d), train=0.6, validation=0.2, mode="row_fraction").select("id", "split")


@query(
    "t02_split_time_fraction",
    f"""WITH {TX}, {GRID}, b AS (SELECT greatest(1, CAST(floor(max(k) * 0.6::DOUBLE) AS BIGINT)) AS ia,
    CAST(floor(max(k) * {0.6 + 0.2!r}::DOUBLE) AS BIGINT) AS ib0, max(k) AS k FROM g)
SELECT id, CASE WHEN i <= ia THEN 'train' WHEN i <= least(greatest(ia + 1, ib0), b.k - 1) THEN 'validation' ELSE 'test' END AS split
FROM tx JOIN g USING (step), b""",
)
def _(spark, d):
    return S.temporal_split(tx(spark, d), train=0.6, validation=0.2, mode="time_fraction").select("id", "split")


@query("t03_rolling_boundaries", f"WITH {TX}, {BOUNDS} SELECT * FROM bounds")
def _(spark, d):
    return folds(tx(spark, d))


@query(
    "t03_rolling_splits",
    f"WITH {TX}, {BOUNDS} SELECT fold, split, id FROM tx JOIN bounds ON step BETWEEN start_time AND end_time",
)
def _(spark, d):
    return S.rolling_splits(tx(spark, d)).select("fold", "split", "id")


@query(
    "t04_calibration_threshold_split",
    f"""WITH {TX}, {GRID}, f AS (SELECT * FROM g WHERE i < k AND cpos > 0 AND cum - cpos > 0 AND tpos - cpos > 0
    AND total - tpos - (cum - cpos) > 0)
SELECT i AS boundary, step AS last_time, cum::BIGINT AS first_rows FROM f ORDER BY abs(cum - total / 2), i LIMIT 1""",
)
def _(spark, d):
    return S.calibration_threshold_boundaries(tx(spark, d), "step", "label")


@query(
    "t05_audit_split",
    f"""WITH {TX}, {GRID}, a AS (SELECT arg_min(i, (abs(cum - total * 0.7::DOUBLE), i)) AS ia FROM g WHERE i BETWEEN 1 AND k - 2),
b AS (SELECT ia, arg_min(i, (abs(cum - total * {0.70 + 0.15!r}::DOUBLE), i)) AS ib FROM g, a WHERE i BETWEEN ia + 1 AND k - 1 GROUP BY ia)
SELECT CASE WHEN i <= ia THEN 'train' WHEN i <= ib THEN 'validation' ELSE 'test' END AS split, min(step) AS start_time,
  max(step) AS end_time, sum(n)::BIGINT AS rows, sum(pos)::BIGINT AS positives, round(sum(pos)::DOUBLE / sum(n), 6) AS rate
FROM g, b GROUP BY 1""",
)
def _(spark, d):
    return S.audit_split(tx(spark, d)).withColumn("rate", F.round("rate", 6))


RANGES = {"train": (0, 1599), "validation": (1600, 1999), "test": (2000, 2600)}


@query(
    "t06_fixed_splits",
    f"""WITH {SHOP} SELECT CASE WHEN step BETWEEN 0 AND 1599 THEN 'train' WHEN step BETWEEN 1600 AND 1999 THEN 'validation'
  WHEN step BETWEEN 2000 AND 2600 THEN 'test' END AS split, count(*) AS rows, sum(label)::BIGINT AS positives FROM shop GROUP BY 1""",
)
def _(spark, d):
    return S.fixed_splits(shop(spark, d), RANGES).groupBy("split").agg(
        F.count("*").alias("rows"), F.sum("label").cast("bigint").alias("positives")
    )


@query(
    "t07_apply_boundaries",
    f"""WITH {TX}, {BOUNDS} SELECT fold, split, count(*) AS rows, count(*) AS found_rows, true AS matches
FROM tx JOIN bounds ON step BETWEEN start_time AND end_time GROUP BY ALL""",
)
def _(spark, d):
    rows = tx(spark, d)
    stored = folds(rows)
    counts = S.time_grid(rows, "step").select("step", "cum_rows", "n")
    ends = counts.select(F.col("step").alias("end_time"), F.col("cum_rows").alias("upto"))
    starts = counts.select(F.col("step").alias("start_time"), (F.col("cum_rows") - F.col("n")).alias("before"))
    expected = stored.join(ends, "end_time").join(starts, "start_time").select(
        "fold", "split", (F.col("upto") - F.col("before")).alias("rows")
    )
    return S.verify_counts(S.apply_boundaries(rows, stored), expected)


@query(
    "t08_fold_summary",
    f"""WITH {TX}, {BOUNDS} SELECT fold, split, min(step) AS start_time, max(step) AS end_time, count(*) AS rows,
  sum(label)::BIGINT AS positives, round(avg(label), 6) AS rate
FROM tx JOIN bounds ON step BETWEEN start_time AND end_time GROUP BY fold, split""",
)
def _(spark, d):
    return S.split_summary(S.rolling_splits(tx(spark, d))).withColumn("rate", F.round("rate", 6))


@query(
    "t09_validate_folds",
    f"""WITH {TX}, {BOUNDS}, p AS (SELECT fold, max(CASE WHEN split = 'train' THEN end_time END) AS tr,
    min(CASE WHEN split = 'train' THEN start_time END) AS tr0, min(CASE WHEN split = 'validation' THEN start_time END) AS va0,
    max(CASE WHEN split = 'validation' THEN end_time END) AS va, min(CASE WHEN split = 'test' THEN start_time END) AS te0,
    max(CASE WHEN split = 'test' THEN end_time END) AS te FROM bounds GROUP BY fold),
m AS (SELECT fold, step, count(DISTINCT split) AS c FROM tx JOIN bounds ON step BETWEEN start_time AND end_time GROUP BY ALL)
SELECT 'strict_time_order' AS "check", fold, CAST(NOT (tr < va0 AND va < te0) AS BIGINT) AS violations FROM p
UNION ALL SELECT 'time_isolation', fold, count(*) FILTER (c > 1) FROM m GROUP BY fold
UNION ALL SELECT 'forward_motion', a.fold, CAST(NOT (a.tr > b.tr AND a.va > b.va AND a.te > b.te) AS BIGINT)
  FROM p a JOIN p b ON b.fold = a.fold - 1
UNION ALL SELECT 'final_coverage', p.fold, (SELECT count(*) FROM tx WHERE step NOT BETWEEN p.tr0 AND p.te)
  FROM p WHERE p.fold = (SELECT max(fold) FROM p)""",
)
def _(spark, d):
    rows = tx(spark, d)
    return S.validate_folds(rows, S.rolling_splits(rows))


@query(
    "t10_segments",
    f"""WITH {SHOP} SELECT s.name AS segment, count(*) AS rows, sum(label)::BIGINT AS positives FROM shop,
  (VALUES ('all', 2000, 2600), ('early', 2000, 2199), ('late', 2200, 2600)) s(name, a, b) WHERE step BETWEEN a AND b GROUP BY 1""",
)
def _(spark, d):
    out = S.segments(shop(spark, d), {"all": (2000, 2600), "early": (2000, 2199), "late": (2200, 2600)}, "step")
    return out.groupBy("segment").agg(F.count("*").alias("rows"), F.sum("label").cast("bigint").alias("positives"))


@query(
    "t11_time_bins",
    f"""WITH {TX}, b AS (SELECT min(step) AS lo, max(step) AS hi FROM tx)
SELECT id, CAST(greatest(1, least(10, ceil((step - lo) * 10 / (hi - lo)::DOUBLE))) AS INTEGER) AS time_bin FROM tx, b""",
)
def _(spark, d):
    return S.time_bins(tx(spark, d), 10).select("id", "time_bin")
