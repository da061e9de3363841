"""Isotonic maps per cell against the max-min formula and the one-cell model of Spark."""

import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskframe.operators import calibration as C
from riskframe.plans.canon import ledger

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Per level the largest, over starts, of the smallest mean up to any end: (score, label) rows."""
    n, pos = defaultdict(int), defaultdict(int)
    for x, y in rows:
        n[x] += 1
        pos[x] += y
    xs, best = sorted(n), {}
    for j in range(len(xs)):
        means, a, b = [], 0, 0
        for x in xs[j:]:
            a, b = a + pos[x], b + n[x]
            means.append(Fraction(a, b))
        low = None
        for i in reversed(range(len(means))):
            low = means[i] if low is None else min(low, means[i])
            best[xs[j + i]] = max(best.get(xs[j + i], low), low)
    return best


def test_every_cell_matches_brute_force(spark):
    rng = random.Random(5)
    shape = {"up": lambda x: x, "down": lambda x: 1 - x, "flat": lambda x: 0.3, "none": lambda x: 0, "steps": lambda x: round(3 * x) / 3}
    rows = [(c, k, x, int(rng.random() < f(x))) for c, f in shape.items() for k in (1, 2) for x in (round(rng.random(), 2) for _ in range(300))]
    df = spark.createDataFrame(rows, "model string, fold int, raw double, label int").repartition(5)
    keys = ["fold", "model"]
    found = C.isotonic_apply(df, keys, "raw", C.isotonic_fit(df, keys, "raw", "label")).collect()
    assert len(found) == len(rows)
    for c in shape:
        for k in (1, 2):
            want = brute([(x, y) for m, f, x, y in rows if (m, f) == (c, k)])
            assert all(r["isotonic"] == pytest.approx(float(want[r["raw"]])) for r in found if (r["model"], r["fold"]) == (c, k))


@pytest.mark.parametrize("classes", [2, 3, 40])
def test_classes_do_not_change_the_map(spark, classes):
    rng = random.Random(classes)
    rise = {"noise": lambda x: 0.5, "wave": lambda x: 0.5 + 0.4 * math.sin(9 * x), "rise": lambda x: x * x, "fall": lambda x: 1 - x, "ones": lambda x: 1}
    rows = [(c, x, int(rng.random() < f(x))) for c, f in rise.items() for x in (round(rng.random(), 3) for _ in range(700))]
    rows += [("alternate", k / 100, k % 2) for k in range(100)] + [("one", 0.5, 1)]
    df = spark.createDataFrame(rows, "model string, raw double, label int")
    fitted = C.isotonic_fit(df, ["model"], "raw", "label", classes=classes).collect()
    for c in {r[0] for r in rows}:
        want = brute([(x, y) for m, x, y in rows if m == c])
        blocks = sorted((r for r in fitted if r["model"] == c), key=lambda r: r["block"])
        assert [r["block"] for r in blocks] == list(range(1, len(blocks) + 1))
        assert sorted(set(want.values())) == [pytest.approx(r["isotonic"]) for r in blocks]
        for r, after in zip(blocks, blocks[1:] + [None]):
            assert {v for x, v in want.items() if r["low"] <= x <= r["high"]} == {want[r["low"]]} and float(want[r["low"]]) == pytest.approx(r["isotonic"])
            assert (r["next_low"], r["next_isotonic"]) == ((after["low"], after["isotonic"]) if after else (None, None))


def test_unseen_scores_follow_the_one_cell_model(spark):
    rng = random.Random(6)
    rows = [(1, x, int(rng.random() < x)) for x in (round(rng.uniform(0.2, 0.8), 2) for _ in range(200))]
    df = spark.createDataFrame(rows, "k int, raw double, label int")
    asked = spark.range(0, 1001).select(F.lit(1).alias("k"), (F.col("id") / 1000).alias("raw"))
    model = IsotonicRegression(featuresCol="raw", labelCol="y", weightCol="w", predictionCol="want").fit(
        df.groupBy("raw").agg(F.avg("label").alias("y"), F.count("*").cast("double").alias("w"))
    )
    fitted = C.isotonic_fit(df, ["k"], "raw", "label")
    out = C.isotonic_apply(model.transform(asked), ["k"], "raw", fitted).collect()
    assert len(out) == 1001 and all(r["isotonic"] == pytest.approx(r["want"]) for r in out)
    odd = spark.createDataFrame([(1, None), (1, float("nan")), (2, 0.5), (1, 0.5), (1, 0.5)], "k int, raw double")
    values = [r["isotonic"] for r in C.isotonic_apply(odd, ["k"], "raw", fitted).collect()]
    assert len(values) == 5 and sum(v is None for v in values) == 3


def test_query_covers_all_cells(spark):
    cells = defaultdict(list)
    for r in ledger(spark, SF, "validation").collect():
        cells[r["fold"], r["seed"], r["model"]].append((r["raw"], r["label"]))
    found = entry.queries()["c02_isotonic_cells"](spark, SF).collect()
    assert len(cells) == 36 and len(found) == sum(map(len, cells.values()))
    want = {k: brute(rows) for k, rows in cells.items()}
    assert all(r["isotonic"] == round(float(want[r["fold"], r["seed"], r["model"]][r["raw"]]), 6) for r in found)
