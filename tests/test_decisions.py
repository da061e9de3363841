"""Thresholds, ties and capacities against hand values and exhaustive search."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from riskframe.functions.prefix import ordered_quantiles, rank_rows
from riskframe.functions.scalars import clip_score, exact_cents, review_slots
from riskframe.operators import calibration as C
from riskframe.operators import decisions as D
from riskframe.operators import metrics as M


def frame(spark, y, s):
    return spark.createDataFrame([("m", i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "model string, id bigint, label int, raw double")


def test_no_alert_can_be_cheapest(spark):
    # The only alerts within the cap are 400 rows that hold one of 20 positives: they cost more than they save.
    y = [0] * 399 + [1] + [1] * 19 + [0] * 7581
    s = [0.8] * 400 + [0.25] * 7600
    best = D.optimize_threshold(frame(spark, y, s), ["model"], "raw", "label", 350, 1, max_alert_rate=0.08).first()
    assert (best["cost"], best["alerts"]) == (20 * 350, 0) and best["threshold"] > 0.8
    kept = D.optimize_threshold(frame(spark, y, s), ["model"], "raw", "label", 450, 1, max_alert_rate=0.08).first()
    assert (kept["cost"], kept["alerts"], kept["threshold"]) == (19 * 450 + 399, 400, 0.8)


def test_thresholds_match_exhaustive_search(spark):
    rng = random.Random(11)
    y = [int(rng.random() < 0.3) for _ in range(250)]
    s = [round(rng.random(), 2) for _ in range(250)]
    best = D.optimize_threshold(frame(spark, y, s), ["model"], "raw", "label", 7, 1, max_alert_rate=0.4).first()
    options = []
    for t in [*sorted(set(s)), 2.0]:
        alerts = sum(v >= t for v in s)
        tp = sum(a for a, v in zip(y, s) if v >= t)
        if alerts / 250 <= 0.4:
            options.append((7 * (sum(y) - tp) + alerts - tp, -tp, alerts, -t))
    cost, tp, alerts, t = min(options)
    assert (best["cost"], best["tp"], best["alerts"], best["threshold"]) == (cost, -tp, alerts, -t)


def test_tie_bounds_over_all_subsets(spark):
    y, s = [0, 1, 1, 0, 1, 0, 0, 0, 1, 0], [0.8, 0.75, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.3, 0.2]
    p = D.capacity_profile(frame(spark, y, s), ["model"], "raw", "label", [0.55], "id").first()
    assert p["alerts"] == 6
    found = [1 + sum(y[i] for i in c) for c in itertools.combinations(range(2, 8), 4)]
    assert (p["tp_min"], p["tp_max"]) == (min(found), max(found))
    assert p["tp_expectation"] == pytest.approx(sum(found) / len(found))
    assert p["tp"] == 1 + sum(y[2:6])


def test_average_precision_and_hash_ties_by_hand(spark):
    df = frame(spark, [0, 1, 1, 0, 1], [5, 4, 2, 2, 1])
    # Levels: 0 of 1, 1 of 2, 2 of 4, 3 of 5 found; each positive counts the precision of its level.
    assert M.average_precision(df, ["model"], "raw", "label").first()["ap"] == pytest.approx((1 / 2 + 2 / 4 + 3 / 5) / 3)
    p = D.capacity_profile(df, ["model"], "raw", "label", [0.6]).first()
    assert (p["tie_n"], p["tp_min"], p["tp_max"]) == (2, 1, 2)
    pick = lambda d: {r["id"] for r in D.hash_priority_capacity(d, ["model"], "raw", "label", "id", 0.6).where("selected = 1").collect()}
    assert pick(df) == pick(df.orderBy(F.desc("id")).repartition(3)) and len(pick(df)) == 3


def test_integer_capacity(spark):
    rows = spark.createDataFrame([(100_001,), (7,), (200,), (1,)], "n bigint").select(review_slots(F.col("n"), 0.03).alias("k"))
    assert [r["k"] for r in rows.collect()] == [3001, 1, 6, 1]


def test_undefined_scores_are_kept_and_never_alerted(spark):
    s = [0.9, None, 0.7, float("nan"), 0.5, float("inf"), 0.5, 0.1]
    df = spark.createDataFrame([("m", i, i % 2, v) for i, v in enumerate(s)] + [("none", 9, 0, None)], "model string, id bigint, label int, raw double")
    for ranks in (False, True):
        out = {(r["model"], r["id"]): r["selected"] for r in D.fixed_capacity(df, ["model"], "raw", "label", "id", 0.6, ranks).collect()}
        assert len(out) == 9 and {k for k, v in out.items() if v} == {("m", 0), ("m", 2), ("m", 4)}
    assert D.hash_priority_capacity(df, ["model"], "raw", "label", "id", 0.6).agg(F.count("*"), F.sum("selected")).first()[:] == (9, 3)
    cut = spark.createDataFrame([("m", 0.5), ("none", 0.5)], "model string, threshold double")
    assert D.apply_threshold(df, "raw", cut, ["model"]).agg(F.sum("alert")).first()[0] == 4
    assert [tuple(r) for r in D.invalid_scores(df, ["model"], "raw").orderBy("model").collect()] == [("m", 8, 3), ("none", 1, 1)]
    for run in (lambda: D.optimize_threshold(df, ["model"], "raw", "label", 5), lambda: M.average_precision(df, ["model"], "raw", "label")):
        with pytest.raises(Exception, match="undefined score"):
            run().collect()
    assert [r[0] for r in df.where("id < 2").orderBy("id").select(clip_score(F.col("raw"))).collect()] == [0.9, None]


def test_infeasible_limits_are_rejected(spark):
    found = D.optimize_threshold(frame(spark, [1, 0, 0, 0], [0.1, 0.9, 0.8, 0.7]), ["model"], "raw", "label", 5, min_precision=0.9, max_fnr=0.5)
    with pytest.raises(ValueError):
        D.require_feasible(found, 1)


def test_logistic_maps_of_all_cells_equal_single_fits(spark):
    rng = random.Random(9)
    rows = [(f, i, int(rng.random() < 0.1 + 0.5 * v), v) for f in (1, 2) for i in range(1500) for v in [round(rng.random() ** f, 2)]]
    rows += [(3, i, int(v < 0.5), v) for i in range(200) for v in [rng.random()]]  # falling: the slope stays at its bound
    df = spark.createDataFrame(rows, "fold int, id int, label int, raw double")
    cells = {r["fold"]: r for r in C.platt_fit_cells(df, ["fold"], "raw", "label").collect()}
    for f in (1, 2):
        slope, intercept = C.platt_fit(df.where(F.col("fold") == f), "raw", "label")
        assert (cells[f]["slope"], cells[f]["intercept"]) == (pytest.approx(slope, abs=1e-4), pytest.approx(intercept, abs=1e-4))
    share = sum(r[2] for r in rows if r[0] == 3) / 200
    assert cells[3]["slope"] == C.LEAST_SLOPE and cells[3]["intercept"] == pytest.approx(math.log(share / (1 - share)), abs=1e-3)


def test_ranks_split_a_tie_that_holds_most_rows(spark):
    rng = random.Random(2)
    rows = [("m", i, 0.5 if rng.random() < 0.7 else rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "model string, id bigint, raw double").withColumn("part", F.floor(F.col("id") / 100))
    out = {r["id"]: r["score_rank"] for r in rank_rows(df, ["model"], "raw", "id", "part").collect()}
    order = sorted(rows, key=lambda r: (-r[2], r[1]))
    assert out == {r[1]: k for k, r in enumerate(order, 1)}


def test_exact_quantiles(spark):
    rng = random.Random(4)
    values = [round(rng.gauss(0, 1), 2) for _ in range(1001)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    found = {r["probability"]: r["value"] for r in ordered_quantiles(df, ["k"], "v", [0.0, 0.123, 0.5, 1.0], ranges=7).collect()}
    ordered = sorted(values)
    for p, v in found.items():
        at = p * 1000
        lo, hi = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert v == pytest.approx(lo + (hi - lo) * (at - math.floor(at)))


def test_exact_cents_rejects(spark):
    texts = ["10.01", "1.001", "nan", "", None, "-3", "99999999999999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(exact_cents(F.col("t")).alias("c"))
    assert [r["c"] for r in df.collect()] == [1001, None, None, None, None, -300, None]
