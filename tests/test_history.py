"""Hand values, brute force, and invariance of strictly-past history."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from riskframe.operators import audits as A
from riskframe.operators import checks as V
from riskframe.operators import history as H

SCHEMA = "id bigint, step int, recipient string, origin string, amount_cents bigint, label int"


def test_same_step_rows_do_not_see_each_other(spark):
    rows = [(0, 1, "X", "a", 1000, 0), (1, 2, "X", "b", 1000, 0), (2, 2, "X", "c", 1000, 1), (3, 3, "Z", "d", 1000, 0)]
    out = H.range_history_exact(spark.createDataFrame(rows, SCHEMA), windows=(1, 24))
    assert [r["count_1"] for r in out.orderBy("id").collect()] == [0, 1, 1, 0]


def test_exact_cents_by_hand(spark):
    rows = [(0, 3, "A", "u", 305, 0), (1, 3, "A", "v", 710, 1), (2, 4, "A", "v", 999, 0), (3, 4, "A", "w", 1, 0), (4, 4, "A", "u", 42, 0), (5, 12, "A", "w", 8, 1)]
    out = H.range_history_exact(spark.createDataFrame(rows, SCHEMA), windows=(1, 9, 30)).orderBy("id").collect()
    assert [r["count_1"] for r in out] == [0, 0, 2, 2, 2, 0]
    assert [r["count_9"] for r in out] == [0, 0, 2, 2, 2, 5]
    assert [r["distinct_30"] for r in out] == [0, 0, 2, 2, 2, 3]
    assert out[3]["mean_1"] == 5.075 and out[5]["mean_9"] == pytest.approx(20.57 / 5)
    assert [r["recency"] for r in out] == [-1, -1, 1, 1, 1, 8]
    assert [r["pair_9"] for r in out] == [0, 0, 1, 0, 1, 1]


def random_world(seed, n, hot=0.0):
    rng = random.Random(seed)
    return [
        (i, rng.randint(1, 60), "hot" if rng.random() < hot else rng.choice("PQR"), rng.choice("abcde"), rng.randint(1, 100000), i % 3 == 0)
        for i in range(n)
    ]


def brute(rows, windows):
    out = {}
    for i, step, recipient, origin, cents, _ in rows:
        past = [r for r in rows if r[2] == recipient and r[1] < step]
        record = {"recency": step - max((r[1] for r in past), default=step + 1)}
        for w in windows:
            inside = [r for r in past if r[1] >= step - w]
            money = [r[4] / 100 for r in inside]
            record[f"count_{w}"] = len(inside)
            record[f"mean_{w}"] = sum(r[4] for r in inside) / (100 * len(inside)) if inside else 0.0
            record[f"max_{w}"] = max(money, default=0.0)
            record[f"std_{w}"] = statistics.stdev(money) if len(money) > 1 else 0.0
            record[f"distinct_{w}"] = len({r[3] for r in inside})
            record[f"pair_{w}"] = sum(r[3] == origin for r in inside)
        out[i] = record
    return out


@pytest.mark.parametrize("span,hot", [(None, 0.0), (7, 0.5)])
def test_matches_brute_force_even_for_a_hot_entity_cut_into_ranges(spark, span, hot):
    rows = random_world(3, 240, hot)
    df = spark.createDataFrame([(*r[:5], int(r[5])) for r in rows], SCHEMA)
    expected = brute(rows, (1, 6))
    for r in H.range_history_exact(df, windows=(1, 6), span=span).collect():
        for name, value in expected[r["id"]].items():
            assert r[name] == pytest.approx(value, abs=1e-9), (r["id"], name)


def test_partitioning_label_and_later_rows_do_not_matter(spark):
    rows = random_world(5, 200)
    df = spark.createDataFrame([(*r[:5], int(r[5])) for r in rows], SCHEMA)
    key = lambda d: sorted(tuple(r) for r in d.drop("label").where("id < 1000").collect())
    base = key(H.range_history_exact(df, windows=(6,)))
    assert key(H.range_history_exact(df.repartition(13), windows=(6,), span=11)) == base
    assert key(H.range_history_exact(df.withColumn("label", 1 - F.col("label")), windows=(6,))) == base
    later = df.withColumns({"id": F.col("id") + 1000, "step": F.col("step") + 60})
    assert key(H.range_history_exact(df.unionByName(later), windows=(6,))) == base


def test_card_entities(spark):
    schema = "id bigint, t bigint, card1 int, card2 double, category string, amount_cents bigint, label int"
    rows = [
        (11, 40, 3, 5.0, "P", 600, 0), (12, 90, 3, 5.0, "P", 1800, 1), (13, 130, 3, 5.0, "Q", 2700, 0), (14, 260, 3, 5.0, "P", 3400, 0),
        (15, 260, 3, None, "R", 50, 0), (16, 10, 4, 6.0, None, 700, 1),
    ]
    out = {r["id"]: r for r in H.entity_history(spark.createDataFrame(rows, schema), ["card1", "card2"], "combo", span=64).collect()}
    assert out[14]["combo_count"] == 3 and out[14]["combo_mean"] == 17.0
    assert out[14]["combo_std"] == pytest.approx(statistics.stdev([6, 18, 27]))
    assert out[14]["combo_ratio"] == pytest.approx(34 / (17 + 1e-6))
    assert out[14]["combo_distinct"] == 2 and out[14]["combo_recency"] == 130
    assert out[15]["combo_available"] == 0 and out[15]["combo_count"] is None and out[15]["combo_has_history"] == 0
    assert out[16]["combo_count"] == 0 and out[16]["combo_mean"] is None


def test_merchant_modes(spark):
    schema = "id bigint, step int, merchant string, customer string, amount_cents bigint"
    steps = [4, 4, 6, 9, 40, 5, 5]
    rows = [(i, s, "N" if i > 4 else "M", f"c{i % 2}", 250 * (i + 1)) for i, s in enumerate(steps)]
    df = spark.createDataFrame(rows, schema)
    full = {r["id"]: r for r in H.merchant_history(df).collect()}
    short = {r["id"]: r for r in H.merchant_history(df, mode="HS").collect()}
    assert full[4]["h1_count"] == 0 and full[4]["recency"] == 31 and full[4]["h30_count"] == 0 and full[3]["h7_count"] == 3
    assert short[4]["recency"] == -1 and short[4]["recency_available"] == 0 and short[3]["recency"] == 3
    assert H.merchant_history(df, mode="H0").columns == df.columns
    with pytest.raises(ValueError):
        H.merchant_history(df, mode="XX")


def test_history_sets_find_what_a_listing_would(spark):
    rng = random.Random(12)
    rows = spark.createDataFrame([(f"r{i}", rng.choice("ab"), rng.randrange(40)) for i in range(300)], "id string, merchant string, step int")
    listed = H.history_provenance(rows).cache()
    owners = rows.select("id", "merchant", "step")
    legal = owners.join(H.history_sets(rows, span=9).drop("rows"), ["merchant", "step"]).withColumn("rows", F.lit(1))

    def violations(listing):
        found = owners.select("id").join(H.listed_sets(listing), "id", "left")
        return {r["check"]: r["violations"] for r in V.aligned_sets(legal, found, ["id"]).collect()}

    assert violations(listed) == {"history_legal": 0, "history_complete": 0}
    lost = listed.where("used_id <> 'r17'")
    assert violations(lost) == {"history_legal": 0, "history_complete": listed.count() - lost.count()} and lost.count() < listed.count()
    other = listed.withColumn("used_id", F.when(F.col("id") == "r5", F.concat("used_id", F.lit("x"))).otherwise(F.col("used_id")))
    assert violations(other)["history_legal"] == 1
    more = listed.unionByName(rows.where("id = 'r9'").select("id", "merchant", "step", F.lit("r9").alias("used_id"), F.col("step").alias("used_time")))
    assert violations(more) == {"history_legal": 1, "history_complete": 0}
    asked = H.history_provenance(rows, asked=rows.where("id IN ('r1', 'r2')"))
    assert asked.exceptAll(listed).count() == 0 and asked.count() == listed.where("id IN ('r1', 'r2')").count()


def test_leakage_audit_counts_every_leaking_row_of_a_first_time(spark):
    rows = spark.createDataFrame([(i, 5 if i < 4 else 9, "c", 100, 0) for i in range(6)], "id int, t int, card1 string, amount_cents bigint, label int")
    good = H.build_entity_features(rows, {"card": ["card1"]}, category=None)
    leaky = good.withColumn("card_count", F.col("card_count") + (F.col("id") < 3).cast("int"))
    found = {f: [r["violations"] for r in A.leakage_audit(t, {"card": ["card1"]}, "t", "id").where("check = 'first_row_count_zero'").collect()] for f, t in (("good", good), ("leaky", leaky))}
    assert found == {"good": [0], "leaky": [3]}


def test_only_values_that_return_within_a_window_give_marks(spark):
    pairs = spark.createDataFrame([("X", "a", 1), ("X", "b", 2), ("X", "a", 5), ("X", "c", 40), ("X", "b", 90)], "recipient string, origin string, step int")
    marks = H.window_repeats(pairs, ["recipient"], ["origin"], "step", [3, 7], 256).collect()
    # a is seen at 1 and 5: repeated in the window of 7 for times 6 to 8, never in that of 3; b and c do not return in time.
    assert sorted((r["step"], r["_r3"], r["_r7"]) for r in marks) == [(6, None, 1), (9, None, -1)]


def brute_merchant(rows, windows, limit):
    """``merchant_history`` by hand: (count, customers, mean, max, std) of each window, and the recency."""
    out = {}
    for i, step, merchant, customer, cents in rows:
        past = [r for r in rows if merchant is not None and step is not None and r[2] == merchant and r[1] is not None and r[1] < step]
        record = {"recency": step - max(r[1] for r in past) if past else -1}
        record["recency"] = record["recency"] if limit is None or record["recency"] <= limit else -1
        for w in windows:
            inside = [r for r in past if r[1] >= step - min(w, limit or w)]
            money = [r[4] / 100 for r in inside]
            record[f"h{w}_count"] = len(inside)
            record[f"h{w}_customers"] = len({r[3] for r in inside if r[3] is not None})
            record[f"h{w}_mean"] = sum(money) / len(money) if money else 0.0
            record[f"h{w}_max"] = max(money, default=0.0)
            record[f"h{w}_std"] = statistics.stdev(money) if len(money) > 1 else 0.0
        record["recency_available"] = int(record["recency"] >= 0)
        out[i] = record
    return out


@pytest.mark.parametrize("mode,limit", [("HL", None), ("HS", 7)])
def test_merchant_history_of_hot_lone_and_unknown_keys_by_brute_force(spark, mode, limit):
    rng = random.Random(8)
    rows = [(i, rng.choice([*range(-20, 60), 400]), rng.choice(["M", "M", "N", "O"]), rng.choice("abcdef"), rng.randint(1, 10**7)) for i in range(300)]
    rows += [(300 + i, s, m, c, 700) for i, (s, m, c) in enumerate([(5, "M", None), (6, "M", None), (6, None, "a"), (7, None, "a"), (None, "M", "a"), (None, None, None)])]
    df = spark.createDataFrame(rows, "id bigint, step int, merchant string, customer string, amount_cents bigint")
    expected = brute_merchant(rows, (1, 7, 30), limit)
    for span in (None, 9):
        out = H.merchant_history(df, mode=mode, span=span).collect()
        assert len(out) == len(rows)
        for r in out:
            for name, value in expected[r["id"]].items():
                assert r[name] == pytest.approx(value, abs=1e-9), (span, r["id"], name)


def shuffles(df):
    """Shuffles that a query writes, and those it reads again, in the plan that ran."""
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    lines = [line for line in ran.split("\n") if "Exchange hashpartitioning" in line]
    return len([line for line in lines if "Reused" not in line]), len([line for line in lines if "Reused" in line])


def test_merchant_history_shuffles_its_rows_once(spark, tmp_path):
    rows = [(i, i % 500, f"m{i % 7}", f"c{i % 11}", 100 + i) for i in range(2000)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "id bigint, step int, merchant string, customer string, amount_cents bigint").write.parquet(path)
    df = spark.read.parquet(path)
    # Besides the rows, HL moves one line a (merchant, range), by merchant and, where it is not broadcast, back.
    assert shuffles(H.merchant_history(df, mode="HS")) == (1, 0)
    written, again = shuffles(H.merchant_history(df, mode="HL"))
    assert written <= 3 and again == 1


def test_history_builds_are_compared_whole_from_one_shuffle(spark, tmp_path):
    rng = random.Random(21)
    rows = [(f"r{i}", rng.choice("aab"), rng.randrange(-30, 90), rng.randint(1, 9000)) for i in range(400)] + [("x", None, 3, 5), ("y", "a", None, 5)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "id string, merchant string, step int, amount_cents bigint").write.parquet(path)
    df = spark.read.parquet(path)
    count = lambda both: {r["check"]: r["violations"] for r in V.aligned_builds(both).collect()}
    clean = {"features_close": 0, "history_legal": 0, "history_complete": 0}
    for spans in ((None, 50), (6, 4), (9, 1)):
        both = H.history_builds(df, spans)
        assert count(both) == clean
        history = H.merchant_history(df, customer=None, windows=(7,), span=spans[1]).where("merchant IS NOT NULL AND step IS NOT NULL")
        want = {(r["merchant"], r["step"]): (r["h7_count"], r["h7_mean"], r["h7_std"]) for r in history.collect()}
        sets = {(r["merchant"], r["step"]): (r["rows"], r["used"], r["id_sum"] or 0, r["id_xor"] or 0) for r in H.history_sets(df, span=11).where("merchant IS NOT NULL AND step IS NOT NULL").collect()}
        found = both.collect()
        for side in "ab":
            assert {(r["merchant"], r["step"]): tuple(r[f"{side}_hi_{f}"] for f in ("count", "mean", "std")) for r in found} == want
            assert {(r["merchant"], r["step"]): tuple(r[f"{side}_{f}"] for f in ("rows", "used", "id_sum", "id_xor")) for r in found} == sets
    listed = H.history_provenance(df).where("used_time % 10 = 0").count()
    assert listed > 0 and count(H.history_builds(df, (6, 4), used=F.col("step") % 10 != 0)) == clean | {"history_complete": listed}
    assert shuffles(V.aligned_builds(H.history_builds(df))) == (1, 0)

    both = H.history_builds(df).cache()
    line = both.where("a_used > 0 AND a_rows > 1").first()
    here = (F.col("merchant") == line["merchant"]) & (F.col("step") == line["step"])
    put = lambda c, v: both.withColumn(c, F.when(here, v).otherwise(F.col(c)))
    assert count(put("b_hi_mean", F.col("b_hi_mean") + 1e-6)) == clean | {"features_close": line["a_rows"]}
    assert count(put("b_rows", F.col("b_rows") + 1)) == clean | {"features_close": 1}
    assert count(put("b_known", F.lit(False)))["features_close"] == line["a_rows"]
    assert count(put("b_id_xor", F.col("b_id_xor") + 1)) == clean | {"history_legal": line["a_rows"]}
    assert count(put("b_used", F.col("b_used") + 1)) == clean | {"history_legal": line["a_rows"]}
    lost = both.select("merchant", "step", *[F.when(~here, F.col(c)).alias(c) if c.startswith("b_") else F.col(c) for c in both.columns[2:]])
    assert count(lost) == {"features_close": line["a_rows"], "history_legal": 0, "history_complete": line["a_rows"] * line["a_used"]}
