"""Exact deduplication, mixing and sharding against brute force and on awkward tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskframe.llm.exact_dedup import duplicate_groups, keep_one
from riskframe.llm.mixing import mix_sources, source_targets, taken_documents
from riskframe.llm.sharding import shard_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use inside.
CLASH = "content string, kept boolean, copies int, size long, node int, m string, bin string"


def awkward(spark):
    rows = [
        (1, "one two three", "en", "b", 13),
        (2, "one two three", "en", "a", 13),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, "word " * 30_000, "en", "a", 150_000),
        (6, " \t\n ", None, None, 4),
        (7, "one two three ", "de", "b", 14),
        (8, "Zwei Wörter", "de", None, 11),
        (8, "Zwei Wörter", "de", None, 11),
        (None, "no id", "en", "a", 5),
    ]
    return spark.createDataFrame([r + (None,) * 7 for r in rows], f"{SCHEMA}, {CLASH}")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return len((text or "").encode().split())


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("weak", [False, True])
def test_groups_match_brute_force(spark, keep, weak):
    docs = awkward(spark)
    how = {"content_hash": lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 32, "0"))} if weak else {}
    found = duplicate_groups(docs, keep=keep, **how).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    pick = min if keep == "min" else max
    want = Counter()
    for text, ids in groups.items():
        best = pick([i for i in ids if i is not None], default=None)
        for i in ids:
            want[(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in found) == want


def test_keep_one_returns_whole_rows_once(spark):
    docs = awkward(spark)
    kept = keep_one(docs, keep="max")
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert Counter(r["text"] or "" for r in rows) == Counter({r["text"] or "": 1 for r in rows})
    by_text = {r["text"]: r for r in rows}
    assert by_text["one two three"]["doc_id"] == 2 and by_text["one two three"]["source"] == "a"
    assert by_text[""]["doc_id"] == 4


def test_no_rows(spark):
    docs = empty(spark)
    assert duplicate_groups(docs).count() == 0 and keep_one(docs).count() == 0
    assert mix_sources(docs).count() == 0 and shard_documents(docs).count() == 0


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, fixed, left = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(w[s] for s in free)
        for s in free:
            target[s] = left * w[s] / total
        over = [s for s in free if target[s] > cap * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = cap * sizes[s]
            fixed.add(s)
            left -= target[s]


def test_targets_are_filled_by_weight_up_to_the_cap(spark):
    for sizes in ({"a": 100, "b": 5000, "c": 40, None: 900}, {"a": 10}, {f"s{i}": (i * 37) % 91 + 1 for i in range(25)}, {"a": 0, "b": 10}):
        found = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r["source"]: pytest.approx(r["target"]) for r in found} == brute_targets(sizes)


def test_mix_meets_targets_and_is_unbiased(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + (id * 7919) % 200 as int)) AS text", "concat('s', cast(pow(id % 10, 2) / 30 as int)) AS source")
    rows = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    taken, target = Counter(), {}
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        assert r["copies"] in (int(r["target"] / r["source_size"]), int(r["target"] / r["source_size"]) + 1, 2)
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 200 for s in target)
    # Long and short documents are taken alike: pivotal draws keep every expectation.
    rate = {s: target[s] / sum(r["size"] for r in rows if r["source"] == s) for s in target}
    drawn = [r["copies"] - rate[r["source"]] for r in rows]
    assert abs(sum(drawn) / len(drawn)) < 0.05


def test_mix_on_awkward_rows(spark):
    docs = awkward(spark)
    mixed = mix_sources(docs)
    rows = mixed.collect()
    assert len(rows) == docs.count()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], words(r["text"])) for r in docs.collect())
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    out = taken_documents(docs, mixed)
    assert out.columns == docs.columns
    want = Counter()
    for r in rows:
        want[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    found = out.collect()
    assert Counter((r["doc_id"], r["source"], words(r["text"])) for r in found) == +want
    assert {(r["doc_id"], r["text"]) for r in found} <= {(r["doc_id"], r["text"]) for r in docs.collect()}


def test_mix_decides_repeated_rows_one_by_one(spark):
    rows = [(None, "a b c d e", "x", {"k": 1})] * 50 + [(None, "f g h i j", "x", {"k": n}) for n in range(10)]
    rows += [(i, "w " * (1 + i % 7), "x", None) for i in range(60)] + [(900, "z " * 12, None, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, meta map<string,int>")
    mixed = mix_sources(docs)
    got = mixed.collect()
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert len({r["copies"] for r in got if r["doc_id"] is None}) == 2
    for source, longest in (("x", 7), (None, 12)):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= longest
    out = taken_documents(docs, mixed)
    assert out.columns == docs.columns
    want = Counter()
    for r in got:
        want[(r["doc_id"], r["size"])] += r["copies"]
    assert Counter((r["doc_id"], words(r["text"])) for r in out.collect()) == +want
    by_map = Counter(tuple((r["meta"] or {}).values()) for r in out.where("text LIKE 'f%'").collect())
    assert by_map and all(n <= 2 and k for k, n in by_map.items())


def test_shards_are_even_and_groups_stay_whole(spark):
    docs = spark.range(4000).selectExpr(
        "id AS doc_id", "repeat(cast(id - id % 3 as string), cast(5 + (id - id % 3) % 97 as int)) AS text", "concat('src', id % 5) AS source", "id % 11 AS n_chars"
    )
    rows = shard_documents(docs, shards=24).collect()
    size, slots, where = Counter(), defaultdict(list), defaultdict(set)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[raw].add(r["shard"])
    assert set(size) == set(range(24)) and all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 24
    assert max(size.values()) - min(size.values()) < 0.1 * mean


def test_shards_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = shard_documents(docs, shards=4).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(0 <= s < 4 for s in by) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert [r["size"] for r in rows if r["doc_id"] == 3] == [8]
    same = docs.select("doc_id", F.lit("all the same").alias("text"), "lang", "source", "n_chars")
    assert {r["shard"] for r in shard_documents(same, shards=4).collect()} == {0}


@pytest.mark.parametrize("keep", ["min", "max"])
def test_kept_rows_may_hold_maps(spark, keep):
    rows = [(1, "a", {"k": 1}), (2, "a", {"k": 2}), (2, "a", None), (None, "a", {"z": 0}), (None, None, None), (3, "", {"e": 5})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>")
    kept = {(r["doc_id"], r["text"]) for r in keep_one(docs, keep=keep).collect()}
    assert kept == {(1 if keep == "min" else 2, "a"), (3, "")}
