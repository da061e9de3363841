"""Split invariants, ingest order and integrity checks."""

import pytest
from pyspark.sql import functions as F

from riskframe.functions.features import leakage_guard
from riskframe.operators import checks as V
from riskframe.operators import history as H
from riskframe.operators import splits as S
from riskframe.sources import tables as T


def test_row_split_is_within_one_step_of_its_target(spark):
    sizes = [40, 3, 55, 17, 90, 26, 71, 8, 64, 33, 12]
    df = spark.createDataFrame([(s,) for s, n in enumerate(sizes) for _ in range(n)], "step int")
    out = {r["split"]: r["count"] for r in S.temporal_split(df, train=0.6, validation=0.2, mode="row_fraction").groupBy("split").count().collect()}
    assert abs(out["train"] / sum(sizes) - 0.6) <= max(sizes) / sum(sizes)
    assert sum(out.values()) == sum(sizes)


def test_rolling_folds_grow_and_stay_ordered(spark):
    df = spark.range(1200).select((F.col("id") % 60).cast("int").alias("step"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    placed = S.rolling_splits(df)
    checks = {(r["check"], r["fold"]): r["violations"] for r in S.validate_folds(df, placed).collect()}
    assert checks and not any(checks.values())
    train = [r["rows"] for r in S.split_summary(placed).where("split = 'train'").orderBy("fold").collect()]
    assert train == sorted(train) and len(set(train)) == 3


def test_rows_outside_every_split_are_rejected(spark):
    df = spark.range(30).select(F.col("id").cast("int").alias("step"))
    ranges = {"train": (0, 9), "test": (10, 19)}
    assert S.require_assigned(S.fixed_splits(df.where("step < 20"), ranges)).count() == 20
    with pytest.raises(ValueError):
        S.require_assigned(S.fixed_splits(df, ranges))


def test_overlapping_boundaries_are_rejected(spark):
    bad = spark.createDataFrame([(1, "train", 0, 10), (1, "test", 10, 20)], "fold int, split string, start_time int, end_time int")
    with pytest.raises(ValueError):
        S.apply_boundaries(spark.range(3).withColumnRenamed("id", "step"), bad)


def test_ingest_keeps_file_order_and_names_bad_rows(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text("step,type,amount,label\n2,a,1.50,0\n1,b,2.25,1\n1,b,2.25,1\n3,c,1.001,0\n4,,1.00,0\n")
    rows = {r["source_row_id"]: r for r in T.ingest_exact(spark, str(path), ["step", "type", "amount", "label"]).collect()}
    assert [rows[i]["amount_cents"] for i in range(3)] == [150, 225, 225]
    assert rows[3]["reject"] == "amount" and rows[4]["reject"] == "empty field"
    with pytest.raises(ValueError):
        T.accepted(T.ingest_exact(spark, str(path), ["step", "type", "amount", "label"]))


def test_alignment_finds_dropped_and_changed_rows(spark):
    base = spark.createDataFrame([(1, 10, 0), (2, 20, 1), (3, 30, 0)], "id int, time int, label int")
    count = lambda other: V.assert_aligned(base, other, base.columns).first()["violations"]
    assert count(base.repartition(3)) == 0
    assert count(base.where("id < 3")) == 1
    assert count(base.withColumn("label", F.when(F.col("id") == 1, 1).otherwise(F.col("label")))) == 2


def test_guards(spark):
    with pytest.raises(ValueError):
        leakage_guard(["label"], ["label"])
    df = spark.createDataFrame([(1, 0, 1, 5), (1, 1, 2, -5)], "id int, label int, step int, amount int")
    with pytest.raises(ValueError):
        V.require_integrity(df, ["id"], "label", "step", "amount")


def test_shared_features_are_compared_by_key_and_counted_by_rows(spark):
    kinds = "id int, k int, a double, b double"
    base = spark.createDataFrame([(1, 1, 1.0, 2.0), (2, 1, 1.0, 2.0), (3, 2, 5.0, 0.0), (4, None, 0.0, 0.0)], kinds)
    count = lambda other: V.close_shared_features(base, other, ["a", "b"], ["k"]).first()["violations"]
    assert count(base) == 0
    assert count(base.withColumn("b", F.when(F.col("k") == 1, F.col("b") + 1).otherwise(F.col("b")))) == 2
    assert count(base.where("id <> 4")) == 1  # a key that is null counts like any other
    assert count(base.where("id <> 2")) == 1  # one row is missing
    assert count(base.where("k = 1 OR k IS NULL")) == 1  # a key is missing
    assert count(base.withColumn("a", F.when(F.col("id") == 2, 9.0).otherwise(F.col("a")))) == 2  # not shared any more
    assert count(base.withColumn("a", F.when(F.col("id") == 3, None).otherwise(F.col("a")))) == 1


def test_history_without_customers_keeps_the_other_columns(spark):
    rows = spark.createDataFrame([(i, i % 2, i % 3, i // 2, 100 * i) for i in range(40)], "id int, merchant int, customer int, step int, amount_cents bigint")
    full = H.merchant_history(rows, windows=(3, 7)).drop("h3_customers", "h7_customers")
    assert V.assert_aligned(full, H.merchant_history(rows, customer=None, windows=(3, 7)), full.columns).first()["violations"] == 0


def test_invariance_audit_builds_its_base_once(spark):
    from riskframe.operators import audits as A

    rows = spark.createDataFrame([(i, i // 3, i % 2) for i in range(12)], "id bigint, step int, label int")
    seen = spark.sparkContext.accumulator(0)

    def build(df):
        def touch(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        return df.mapInPandas(touch, df.schema)

    found = A.invariance_audit(rows, build, "id", "step", "label").collect()
    assert {(r["test"], r["rows"], r["changed_rows"]) for r in found} == {(t, 12, 0) for t in ("label_flip", "shuffle", "future_append")}
    assert seen.value == 12 * (1 + 1 + 1 + 2)
