"""Calibration branches on score levels against the same work on rows."""

import random

import pytest

from riskframe.operators import calibration as C
from riskframe.operators import metrics as M
from riskframe.plans.canon import ledger

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(3), []
    for fold in (1, 2):
        for i in range(400):
            raw = rng.randrange(20) / 20
            out.append((fold, i // 2, int(rng.random() < raw), raw, round(raw * raw, 4)))  # every id twice
    return spark.createDataFrame(out, "fold int, id long, label int, raw double, other double")


def _long(df, counts):
    return df.selectExpr("fold", *counts, "raw", "explode(array(struct('raw' AS m, raw AS s), struct('other' AS m, other AS s))) AS e").selectExpr(
        "fold", "e.m AS method", *counts, "raw", "e.s AS score"
    )


def test_branches_of_levels_equal_branches_of_rows(rows):
    levels = rows.groupBy("fold", "raw", "other").agg({"*": "count", "label": "sum"}).toDF("fold", "raw", "other", "n", "pos")
    told = lambda df, counts, label: {
        (r["fold"], r["method"]): r.asDict() for r in C.evaluate_branch(*[_long(df, counts)] * 2, ["fold", "method"], "score", "raw", label, capacity=0.3).collect()
    }
    want, found = told(rows, ["label"], "label"), told(levels, ["n", "pos"], M.LEVELS)
    assert len(want) == 4 and want.keys() == found.keys()
    assert all(found[k][c] == pytest.approx(v) for k, row in want.items() for c, v in row.items())


def test_decisions_meet_on_their_row_even_where_ids_repeat(spark, rows):
    cuts = {(1, "raw"): 0.5, (1, "other"): 0.5, (2, "raw"): 0.9, (2, "other"): 0.2}
    fields = ("recall", "fp", "fn", "business_cost", "alert_rate", "calibrated_ap")
    results = spark.createDataFrame([(*k, c, *[0.0] * 6) for k, c in cuts.items()], "fold int, method string, threshold double, " + ", ".join(f"{f} double" for f in fields))
    levels = rows.groupBy("fold", "raw", "other").count()
    for table, weight in ((rows, None), (levels, "count")):
        found = {r["fold"]: r for r in C.compare_decisions(table, table, results, ["fold"], {"raw": "raw", "other": "other"}, "raw", weight).collect()}
        assert len(found) == 2
        for fold, r in found.items():
            pairs = [(x["raw"] >= cuts[fold, "raw"], x["other"] >= cuts[fold, "other"]) for x in rows.where(f"fold = {fold}").collect()]
            assert r["test_disagreements"] == sum(a != b for a, b in pairs)
            assert r["test_disagreement_rate"] == pytest.approx(sum(a != b for a, b in pairs) / 400)
            assert r["validation_jaccard"] == pytest.approx(sum(a and b for a, b in pairs) / sum(a or b for a, b in pairs))
            assert r["spearman"] == pytest.approx(1)


def test_platt_maps_of_levels_equal_those_of_rows(rows):
    levels = M.score_levels(rows, ["fold"], "raw", "label")
    told = lambda df, label: {r["fold"]: (r["slope"], r["intercept"]) for r in C.platt_fit_cells(df, ["fold"], "raw", label).collect()}
    want, found = told(rows, "label"), told(levels, M.LEVELS)
    assert all(found[k] == pytest.approx(v) for k, v in want.items())


def test_a_ledger_is_dealt_over_every_part(spark):
    assert len(ledger(spark, SF, "validation").inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))
