"""Grid models fitted together against one fit of Spark's own a cell."""

import math
import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import grouped as G
from riskframe.operators import models as Z

SCHEMES = {
    "two": {"numeric": ["a", "b"]},
    "weighted": {"numeric": ["a", "b", "c"], "positive_weight": 3.0},
    "constant": {"numeric": ["b", "k"]},
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    out = []
    for fold in (1, 2):
        for _ in range(600):
            a, b, c = rng.gauss(50_000, 9_000), rng.random(), float(rng.randrange(4))
            p = 1 / (1 + math.exp(-((a - 50_000) / 9_000 * (1 if fold == 1 else -2) + 3 * b + c - 3)))
            out.append((fold, a, b, c, 7.0, int(rng.random() < p)))
    return spark.createDataFrame(out, "fold int, a double, b double, c double, k double, label int").repartition(5)


def test_cells_equal_single_fits(rows):
    long = G.scheme_rows(rows, SCHEMES, "label", ["fold"])
    fitted = {(r["fold"], r["model"]): r for r in G.fit_logistic_cells(long, ["fold", "model"]).collect()}
    assert len(fitted) == 6 and all(r["converged"] and r["iterations"] < 20 for r in fitted.values())
    for (fold, name), r in fitted.items():
        s = SCHEMES[name]
        one = Z.fit_logistic(rows.where(F.col("fold") == fold), s["numeric"], [], "label", s.get("positive_weight", 1.0))
        assert one.converged and one.attempts[0][1] < 100
        model = one.model.stages[-1]
        for mine, other in zip(r["coefficients"], model.coefficients.toArray()):
            assert mine == pytest.approx(other, rel=1e-5, abs=1e-9)
        assert r["intercept"] == pytest.approx(model.intercept, rel=1e-5, abs=1e-6)
        assert all(c == 0 for c in r["coefficients"][len(s["numeric"]) :])


def test_scores_and_margins(rows):
    long = G.scheme_rows(rows, {"two": SCHEMES["two"]}, "label", ["fold"])
    fitted = G.fit_logistic_cells(long, ["fold", "model"])
    both = G.score_cells(G.score_cells(long, ["fold", "model"], fitted), ["fold", "model"], fitted, "margin", margin=True)
    gap = both.select(F.max(F.abs(F.ln(F.col("raw") / (1 - F.col("raw"))) - F.col("margin")))).first()[0]
    assert gap < 1e-9


def test_separable_and_one_sided_cells_stay_finite(spark):
    rows = [("apart", [float(i)], float(i >= 10), 1.0) for i in range(20)] + [("none", [float(i)], 0.0, 1.0) for i in range(20)]
    cells = spark.createDataFrame(rows, "model string, x array<double>, y double, w double")
    found = {r["model"]: r for r in G.fit_logistic_cells(cells, ["model"], most=40).collect()}
    assert found["apart"]["converged"] and found["apart"]["coefficients"][0] > 0
    assert all(math.isfinite(r["intercept"]) and math.isfinite(r["coefficients"][0]) for r in found.values())


def test_trees_and_retry(rows):
    one = rows.where("fold = 1")
    model = Z.fit_gbt(one, ["a", "b", "c"], [], "label", trees=5, depth=3)
    scored = Z.score(model, one).groupBy("label").agg(F.avg("raw").alias("m")).collect()
    assert {r["label"]: r["m"] for r in scored}[1] > {r["label"]: r["m"] for r in scored}[0] + 0.1
    again = Z.score(Z.fit_gbt(one, ["a", "b", "c"], [], "label", trees=5, depth=3), one)
    assert again.join(Z.score(model, one, "before"), ["a", "b"]).where("raw <> before").count() == 0
    short = Z.fit_logistic(one, ["a", "b"], [], "label", limits=(1, 200))
    assert [limit for limit, _ in short.attempts] == [1, 200] and short.converged
    stuck = Z.fit_logistic(one, ["a", "b"], [], "label", limits=(1, 2))
    assert not stuck.converged and len(stuck.attempts) == 2


def test_newton_steps_read_blocks_not_rows(rows):
    long = G.scheme_rows(rows, SCHEMES, "label", ["fold"])
    blocks = G._blocks(long, ["fold", "model"])
    assert blocks.count() <= 6 * long.rdd.getNumPartitions()
    held = {(r["fold"], r["model"]): r for r in blocks.groupBy("fold", "model").agg(F.sum(F.size("y")).alias("n"), F.sum(F.size("x")).alias("c"), F.sum(F.aggregate("x", F.lit(0.0), lambda a, e: a + e)).alias("s")).collect()}
    for r in long.groupBy("fold", "model").agg(F.count("*").alias("n"), F.sum(F.aggregate("x", F.lit(0.0), lambda a, e: a + e)).alias("s")).collect():
        mine = held[r["fold"], r["model"]]
        assert (mine["n"], mine["c"]) == (r["n"], 3 * r["n"]) and mine["s"] == pytest.approx(r["s"], rel=1e-12)


def test_a_fold_scores_its_rows_in_one_read(rows, spark, tmp_path):
    placed = rows.withColumn("split", F.when(F.col("c") < 3, "train").otherwise("test")).withColumn("id", F.monotonically_increasing_id())
    placed.write.parquet(str(tmp_path / "placed"))
    placed = spark.read.parquet(str(tmp_path / "placed"))
    fit = lambda df, label, seed, **options: Z.fit_gbt(df, label=label, seed=seed, trees=2, depth=2, **options)
    schemes = {"two": {"numeric": ["a", "b"], "categorical": []}, "three": {"numeric": ["a", "b", "c"], "categorical": [], "positive_weight": 3.0}}
    out = Z.run_grid(placed, schemes, (1, 2), "label", "id", fit, (1, 2))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    found = {tuple(r[c] for c in ("fold", "model", "seed", "id")): r["raw"] for r in out.collect()}
    later = placed.where("split = 'test'")
    assert len(found) == 4 * later.count()
    for fold in (1, 2):
        train = placed.where((F.col("fold") == fold) & (F.col("split") == "train"))
        for r in Z.score(fit(train, "label", 2, **schemes["three"]), later.where(F.col("fold") == fold)).collect():
            assert found[fold, "three", 2, r["id"]] == pytest.approx(r["raw"])


def test_margins_build_no_history(spark):
    import __spark_entry__ as entry
    from riskframe.plans import canon

    canon._STORED.clear()
    assert entry.queries()["m03_margin_is_logit"](spark, "/root/testdata/sf0.001").where("agrees <> 1").count() == 0
    assert "featured" not in {name for _, _, name in canon._STORED}
