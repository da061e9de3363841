"""Weighted kernels against the literally duplicated population."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import bootstrap as B
from riskframe.operators import decisions as D
from riskframe.operators import metrics as M
from riskframe.operators import replicates as R

Y = [0, 1, 0, 1, 1, 0, 0, 1, 0, 0]
S = [0.95, 0.7, 0.7, 0.7, 0.7, 0.45, 0.45, 0.2, 0.2, 0.05]
T = [1, 0, 2, 1, 3, 2, 0, 2, 3, 0]
WEIGHTS = [[2, 0, 1, 3], [1, 3, 0, 2], [0, 0, 5, 0]]
KEYS = ["fold", "model"]


@pytest.fixture(scope="module")
def world(spark):
    rows = spark.createDataFrame([(1, "m", i, y, s, t) for i, (y, s, t) in enumerate(zip(Y, S, T))], "fold int, model string, id bigint, label int, raw double, pos int")
    mult = spark.createDataFrame(
        [(1, 2, r + 1, p, w) for r, ws in enumerate(WEIGHTS) for p, w in enumerate(ws) if w], "fold int, block_length int, replicate_id int, pos int, mult int"
    )
    return rows, mult


def test_weighted_kernels_equal_expanded_rows(world):
    rows, mult = world
    table = {r["replicate_id"]: r for r in B.replicate_table(rows, mult, ["fold"], KEYS, "raw", "label", "id", 0.3).collect()}
    full = {r["replicate_id"]: r["ap"] for r in B.weighted_ap(rows, mult, ["fold"], KEYS, "raw", "label").collect()}
    expanded = B.occurrence_rows(rows, mult, ["fold"]).withColumn("copy", F.col("id") * 100 + F.col("occurrence"))
    keys = [*KEYS, "replicate_id"]
    ap = {r["replicate_id"]: r["ap"] for r in M.average_precision(expanded, keys, "raw", "label").collect()}
    top = {r["replicate_id"]: r for r in D.capacity_profile(expanded, keys, "raw", "label", [0.3], "copy").collect()}
    assert set(table) == set(ap) == {1, 2, 3}
    for k in ap:
        assert table[k]["ap"] == pytest.approx(ap[k]) and full[k] == pytest.approx(ap[k])
        assert (table[k]["tp"], table[k]["alerts"], table[k]["n"]) == (top[k]["tp"], top[k]["alerts"], top[k]["rows"])


@pytest.mark.parametrize("width, rows_a_range", [(2, 1), (2, 1_000), (128, 3)])
def test_replicate_vectors_equal_expanded_rows(world, spark, monkeypatch, width, rows_a_range):
    monkeypatch.setattr(R, "RANGE_ROWS", rows_a_range)
    rows, mult = world
    rng = random.Random(width)
    more = [(2, "w", i, int(rng.random() < 0.3), rng.choice([0.1, 0.4, 0.4, 0.8, rng.random()]), rng.randrange(4)) for i in range(120)]
    rows = rows.unionByName(spark.createDataFrame(more, rows.schema))
    mult = mult.unionByName(mult.withColumn("fold", F.lit(2)))
    expanded = B.occurrence_rows(rows, mult, ["fold"]).withColumn("copy", F.col("id") * 100 + F.col("occurrence"))
    keys = [*KEYS, "replicate_id"]
    ap = {(r["fold"], r["replicate_id"]): r["ap"] for r in M.average_precision(expanded, keys, "raw", "label").collect()}
    for q in (0.05, 0.3, 1):
        top = {(r["fold"], r["replicate_id"]): r for r in D.capacity_profile(expanded, keys, "raw", "label", [q], "copy").collect()}
        found = R.vector_replicates(rows, mult, ["fold"], KEYS, "raw", "label", "id", q, width).collect()
        assert len(found) == len(top) == 6
        for r in found:
            k = (r["fold"], r["replicate_id"])
            assert r["ap"] == pytest.approx(ap[k])
            assert (r["n"], r["positives"], r["alerts"], r["tp"]) == (top[k]["rows"], top[k]["positives"], top[k]["alerts"], top[k]["tp"])


@pytest.mark.parametrize("times, cells", [(3, 60), (500, 60)])
def test_weighted_sums_by_matrix_product_and_by_rows(times, cells):
    rng = np.random.default_rng(times)
    group, place = np.sort(np.r_[np.arange(20), rng.integers(0, 20, cells - 20)]), rng.integers(0, times, cells)
    values, m = rng.integers(0, 9, cells).astype(float), rng.integers(0, 4, (times, 5))
    found = R._product(group, place, values, m.astype(float))
    assert found.tolist() == [[sum(int(v) * int(m[t, c]) for g, t, v in zip(group, place, values) if g == k) for c in range(5)] for k in range(20)]


def test_many_rows_tied_at_the_end_of_a_budget(world, spark):
    """400 rows share one level: ranges of ids before a budget's end count whole, those past it not at all, one is walked."""
    rows, mult = world
    tied = spark.range(400).select(F.lit(1).alias("fold"), F.lit("m").alias("model"), "id", (F.col("id") % 3 == 0).cast("int").alias("label"), F.lit(0.9).alias("raw"), (F.col("id") % 4).cast("int").alias("pos"))
    found = {r["replicate_id"]: r["tp"] for r in R.vector_replicates(tied, mult, ["fold"], KEYS, "raw", "label", "id", 0.3).collect()}
    expanded = B.occurrence_rows(tied, mult, ["fold"]).withColumn("copy", F.col("id") * 100 + F.col("occurrence"))
    top = {r["replicate_id"]: r["tp"] for r in D.capacity_profile(expanded, [*KEYS, "replicate_id"], "raw", "label", [0.3], "copy").collect()}
    assert found == top


def test_replicates_without_positives_are_kept_as_null(world):
    rows, mult = world
    none = rows.withColumn("label", F.when(F.col("pos") == 2, 0).otherwise(F.col("label")))
    out = {r["replicate_id"]: r["ap"] for r in B.positive_level_ap(none, mult, ["fold"], KEYS, "raw", "label").collect()}
    assert len(out) == 3 and out[3] is None
    out = {r["replicate_id"]: r["ap"] for r in R.vector_replicates(none, mult, ["fold"], KEYS, "raw", "label").collect()}
    assert len(out) == 3 and out[3] is None


def test_blocks_are_contiguous_legal_and_cut_to_length(spark):
    positions = spark.createDataFrame([(1, t, t, 29) for t in range(29)], "fold int, time int, pos int, groups int")
    draws = B.moving_blocks(positions, ["fold"], 5, 9).collect()
    per = {}
    for d in draws:
        per.setdefault(d["replicate_id"], {})[d["draw"]] = d["pos"]
    assert len(per) == 5 and {d["block_length"] for d in draws} == {3}
    for sequence in per.values():
        assert sorted(sequence) == list(range(29)) and all(0 <= p < 29 for p in sequence.values())
        assert all(sequence[i + 1] == sequence[i] + 1 for i in range(28) if (i + 1) % 3)


def test_interval_counts_invalid_replicates(spark):
    rows = spark.createDataFrame([("x", float(v)) for v in range(1, 6)] + [("x", None)], "k string, value double")
    r = B.interval_summary(rows, ["k"]).first()
    assert (r["draws"], r["valid"], r["invalid"], r["crosses_zero"]) == (6, 5, 1, 0)
    assert r["lower"] == pytest.approx(1.1) and r["upper"] == pytest.approx(4.9)
    assert B.interval_summary(rows, ["k"], min_valid=6).first()["status"] == "insufficient_valid_draws"


def test_replicates_of_counts_equal_those_of_rows(world):
    rows, mult = world
    rows = rows.unionByName(rows.withColumn("id", F.col("id") + 100))
    cells = R.level_counts(rows, KEYS, ["raw"], "label")
    assert 2 * cells.count() == rows.count()
    ordered = lambda df: sorted(map(tuple, df.collect()))
    plain = R.vector_replicates(rows, mult, ["fold"], KEYS, "raw", "label")
    assert ordered(R.vector_replicates(cells, mult, ["fold"], KEYS, "raw", "label", counted=True)) == ordered(plain)
    with pytest.raises(ValueError):
        R.vector_replicates(cells, mult, ["fold"], KEYS, "raw", "label", "id", counted=True)
