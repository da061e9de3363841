"""MaxScore and SimHash against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
import xxhash

from riskframe.llm import simhash
from riskframe.llm.graph import components
from riskframe.llm.maxscore import START, Shard, first_bounds, quantised, top_k


def brute_top(rows, k=20, every=20):
    v, held = {}, []
    for i, e in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        q = [math.floor(64 * x) for x in e]
        held.append((i, q))
        v[i] = min(v.get(i, q), q)
    out = []
    for q in (i for i in v if i % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(v[q], c)), i) for i, c in held if i != q)
        out += [(q, r, c, -s) for r, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(300)]
    rows += [(400, None), (420, [1.0, None]), (440, [float("nan"), 1.0]), (460, [float("inf")]), (480, []), (500, [0.5]), (None, [1.0]), (17, [0.0] * 6), (17, [0.5] * 6), (40, [0.5] * 6), (40, [0.5] * 6), (520, [0.25] * 9)]
    docs = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<float>, shard int, score int")
    found = [tuple(r) for r in top_k(docs).collect()]
    assert sorted(found) == brute_top(rows)
    few = top_k(docs.where("vec_id < 5"))
    assert few.count() == 4 and top_k(docs.where("false")).count() == 0


def test_top_k_over_several_cells(spark, monkeypatch):
    monkeypatch.setattr("riskframe.llm.maxscore.SHARD", 40)
    monkeypatch.setattr("riskframe.llm.maxscore.BLOCK", 4)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(400)]
    rows = [(i, [float(np.float32(x)) for x in e]) for i, e in rows]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in top_k(docs, k=7).collect()) == brute_top(rows, k=7)


def test_huge_components_are_exact_or_refused(spark):
    rows = [(0, [1e7, 3.0]), (1, [2e7, 1.0]), (2, [-1e7, 7.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in top_k(docs).collect()) == brute_top(rows)
    with pytest.raises(Exception, match="64 bits"):
        top_k(spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")).collect()


def test_runs_prune_and_stay_exact(monkeypatch):
    monkeypatch.setattr("riskframe.llm.maxscore.RUN", 16)
    rng = np.random.default_rng(5)
    matrix = rng.integers(-40, 41, (500, 24)).astype(float)
    shard = Shard(np.arange(500), matrix)
    for own in range(0, 500, 50):
        ids, scores = shard.top(own, matrix[own], 10)
        exact = matrix @ matrix[own]
        want = sorted((-s, i) for i, s in enumerate(exact) if i != own)[:10]
        assert list(zip((-scores).tolist(), ids.tolist())) == want


def test_the_registered_table_prunes(spark):
    rows = quantised(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect()
    ids, matrix = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows], float)
    longest = sorted(rows, key=lambda r: -sum(x * x for x in r["v"]))[:START]
    asked = spark.createDataFrame([r for r in rows if r["vec_id"] % 20 == 0], "vec_id long, v array<bigint>")
    bounds = {r["vec_id"]: r["floor"] for r in first_bounds(asked, longest, 20).collect()}
    shard = Shard(ids, matrix)
    for own in range(0, 2000, 20):
        exact = matrix @ matrix[ids == own][0]
        want = sorted((-s, i) for i, s in zip(ids.tolist(), exact.tolist()) if i != own)[:20]
        assert bounds[own] <= -want[-1][0]
        found, scores = shard.top(own, matrix[ids == own][0], 20, bounds[own])
        assert list(zip((-scores).tolist(), found.tolist())) == want
    assert shard.seen < 0.8 * shard.held


def brute_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().translate(simhash._LOWER).split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    texts = [None, "", " \n", "One", "One two", "a b c", "Ä B\tc\x0bd  e", "x " * 70_000, "many words " * 500 + "ÉCOLE"]
    for t in texts:
        assert simhash.fingerprint(t) % (1 << 64) == brute_fingerprint(t)


def test_thresholds_and_parts():
    costs = [[0.0, 9.0, 40.0, 99.0], [0.0, 1.0, 2.0, 50.0], [0.0, 5.0, 30.0, 80.0]]
    want = min((sum(c[t + 1] for c, t in zip(costs, ts)), ts) for ts in itertools.product(range(-1, 3), repeat=3) if sum(ts) == 0)
    assert simhash.allocate(costs, 0) == list(want[1])
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (4000, 64))
    bits[:, 40] = bits[:, 3]
    bits[:, 63] = 1 - bits[:, 3]
    parts = simhash.correlated_parts(4000, bits.T @ bits)
    assert sorted(b for p in parts for b in p) == list(range(64)) and max(map(len, parts)) - min(map(len, parts)) <= 1
    assert any({3, 40, 63} <= set(p) for p in parts)


def brute_classes(words):
    found = {w: {w} for w in words}
    for a, b in itertools.combinations(words, 2):
        if (a ^ b).bit_count() <= 2 and found[a] is not found[b]:
            found[a] |= found[b]
            for w in found[b]:
                found[w] = found[a]
    return {frozenset(s) for s in found.values()}


@pytest.mark.parametrize("dense", [64, 3, None])
def test_links_connect_all_near_words(spark, dense):
    rng = random.Random(8)
    words = {rng.getrandbits(64) for _ in range(200)}
    for center in [0, (1 << 64) - 1, *rng.sample(sorted(words), 6)]:
        words.add(center)
        for _ in range(60):
            w = center
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3, 4])):
                w ^= 1 << b
            words.add(w)
    table = spark.createDataFrame([(simhash._signed(w), i) for i, w in enumerate(sorted(words))], "fp long, first long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.linked_words(table, dense=dense).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    near = {w: {w} for w in words}
    for a, b in links:
        if near[a] is not near[b]:
            near[a] |= near[b]
            for w in near[b]:
                near[w] = near[a]
    assert {frozenset(s) for s in near.values()} == brute_classes(sorted(words))


def test_near_duplicates_on_awkward_rows(spark):
    rows = [(9, "A b c", 1), (4, "a B c", 1), (5, None, 1), (3, " ", 1), (7, "x y " * 3000, 1), (7, "x y " * 3000, 1), (None, "q", 1), (8, "other words here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    want = {9: 4, 4: 4, 5: 3, 3: 3, 7: 7, 8: 8, None: None}
    assert len(found) == len(rows)
    assert all(c == want[i] for i, _, c in found)
    assert {f for i, f, _ in found if i in (3, 5)} == {"0" * 16} and all(len(f) == 16 for _, f, _ in found)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(5, 5), (None, 3)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(200, 400)}, 7: 7}
