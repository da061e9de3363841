"""Vector codes, lattice scores and centroids against brute force."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from riskframe.llm import lattice_lm, vector_codes, vectors
from riskframe.llm.centroids import cluster_vectors
from riskframe.llm.common import crc_fold
from riskframe.llm.lattice_lm import PieceLattice, piece_log_weights, score_texts
from riskframe.llm.queries import piece_model
from riskframe.llm.vector_codes import compress_vectors, displacements

SCHEMA = "vec_id long, embedding array<double>, label int, v int, cluster string, code int, entry int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, y, 1, "x", 2, 3) for i, e, y in rows], SCHEMA)


def kept(rows, scale):
    whole = [(i, e, y) for i, e, y in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    return [(i, [math.floor(scale * x) for x in e], y) for i, e, y in whole]


def squares(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def lloyd(points, centres, rounds):
    """Centres after the rounds and every point's last (index, distance), in Python integers."""
    for at in range(rounds + 1):
        found = [min((squares(p, c), j) for j, c in enumerate(centres)) for p in points]
        if at == rounds:
            return centres, [(j, d) for d, j in found]
        for j in range(len(centres)):
            mine = [p for p, (_, i) in zip(points, found) if i == j]
            if mine:
                centres = [*centres[:j], [sum(c) // len(mine) for c in zip(*mine)], *centres[j + 1 :]]


def null_last(i):
    return (i is None, i or 0)


def brute_codes(rows, parts, k, rounds, scale):
    rows = kept(rows, scale)
    width = -(-max((len(v) for _, v, _ in rows), default=0) // parts) * parts
    rows = sorted(((i, v + [0] * (width - len(v)), y) for i, v, y in rows), key=lambda r: (null_last(r[0]), r[1]))
    w, code, error, books = width // parts, ["" for _ in rows], [0] * len(rows), []
    for p in range(parts):
        points = [v[p * w : (p + 1) * w] for _, v, _ in rows]
        book, found = lloyd(points, points[:k], rounds)
        books += [x for entry in book for x in entry]
        for n, (j, d) in enumerate(found):
            code[n] += f"{j:02x}"
            error[n] += d
    by_label = defaultdict(int)
    for (_, _, y), e in zip(rows, error):
        by_label[y] += e
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted(((i, y, c, e, by_label[y], digest) for (i, _, y), c, e in zip(rows, code, error)), key=str)


def brute_clusters(rows, k, rounds, scale, width, salt):
    rows = [(i, v) for i, v, _ in kept(rows, scale) if len(v) == width]

    def order(r):
        return (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest(), r[1])

    rows.sort(key=order)
    centres, found = lloyd([v for _, v in rows], [v for _, v in rows[:k]], rounds)
    inertia = Counter()
    for j, d in found:
        inertia[j] += d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digests[j]) for (i, _), (j, d) in zip(rows, found)), key=str)


def sample(n, width, seed, choice=None):
    rng = random.Random(seed)
    rows = [(i, [rng.choice(choice) if choice else rng.gauss(0, 1) for _ in range(width)], rng.choice([None, 1, 1, 2])) for i in range(n)]
    odd = [(900, None, 1), (901, [1.0] * (width - 1) + [None], 1), (902, [float("nan")] * width, 2), (903, [float("-inf")] * width, None)]
    ends = [(7, [0.25] * width, 1), (7, [0.25] * width, 1), (None, [0.5] * width, None), (None, [0.5] * width, 2)]
    return rows + odd + ends


@pytest.mark.parametrize("choice", [None, [-0.5, 0.0, 0.5]])
def test_codes_match_brute_force(spark, monkeypatch, choice):
    monkeypatch.setattr(vectors, "CELLS", 400)
    rows = sample(230, 12, 1, choice) + [(950, [0.5] * 5, 3), (951, [], 3)]
    found = compress_vectors(table(spark, rows), parts=4, k=5, rounds=4, scale=64.0)
    assert sorted(map(tuple, found.collect()), key=str) == brute_codes(rows, 4, 5, 4, 64)


def test_codes_of_small_tables(spark):
    assert compress_vectors(table(spark, [(1, None, 1)])).count() == 0
    rows = [(5, [1.0] * 8, None), (3, [2.0] * 8, None), (3, [2.0] * 8, 4)]
    assert sorted(map(tuple, compress_vectors(table(spark, rows)).collect()), key=str) == brute_codes(rows, 8, 16, 6, 4096)
    with pytest.raises(ValueError, match="64 bits"):
        compress_vectors(table(spark, [(1, [1e12] * 8, 1)]))


def test_net_displacement_is_tighter_than_drifts_and_bounds_skip_scans():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 30, (400, 4)) for c in (-400, 0, 400)]).astype(np.int64)
    history, part, scans = rng.choice(points, 8, replace=False)[None, None], vector_codes.Part(points), []
    for _ in range(12):
        net, others = displacements(history)
        part.step(history[-1, 0], net[:, 0], others[:, 0])
        want = ((points[:, None] - history[-1, 0]) ** 2).sum(axis=2)
        assert (part.entry == want.argmin(axis=1)).all()
        assert (part.lower - others[part.lower_round, 0, part.entry] <= np.sqrt(np.sort(want, axis=1)[:, 1])).all()
        scans.append(part.scans)
        sums = part.sums(8)
        history = np.concatenate([history, np.where(sums[:, :1] > 0, sums[:, 1:] // np.maximum(sums[:, :1], 1), history[-1, 0])[None, None]])
    steps = np.sqrt(((history[1:] - history[:-1]) ** 2).sum(axis=3)).sum(axis=0)
    assert (displacements(history)[0][0] <= steps + 1e-6).all() and (displacements(history)[0][0] < 0.9 * steps).any()
    assert scans[0] == len(points) and scans[-1] < 12 * len(points) / 3


@pytest.mark.parametrize("choice", [None, [-0.5, 0.0, 0.5]])
def test_clusters_match_brute_force(spark, monkeypatch, choice):
    monkeypatch.setattr(vectors, "CELLS", 300)
    rows = sample(210, 6, 3, choice) + [(950, [0.5] * 5, 3), (951, [], 3), (952, [1e6] * 6, 3)]
    found = cluster_vectors(table(spark, rows), k=5, rounds=3, scale=64.0, width=6, salt="1")
    assert sorted(map(tuple, found.collect()), key=str) == brute_clusters(rows, 5, 3, 64, 6, "1")


def test_clusters_of_small_tables(spark):
    assert cluster_vectors(table(spark, [(1, [1.0], 1)])).count() == 0
    rows = [(1, [0.5] * 64, 1), (None, [0.25] * 64, 1), (1, [0.5] * 64, 1)]
    assert sorted(map(tuple, cluster_vectors(table(spark, rows)).collect()), key=str) == brute_clusters(rows, 16, 3, 64, 64, "1")
    with pytest.raises(ValueError, match="64 bits"):
        cluster_vectors(table(spark, [(1, [1e12] * 64, 1)]))


def test_lattice_sums_every_segmentation():
    pieces = {"▁": -2.0, "a": -1.5, "b": -2.5, "▁a": -1.0, "ab": -1.7, "aba": -3.0, "ba": -2.2}
    lattice = PieceLattice(pieces, [-6.0] * 256, math.log(0.1))
    for word in ("", "a", "abab", "bbabaab", "aéb"):
        spelled = "▁" + word
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(spelled) - 1):
            parts, start = [], 0
            for at, cut in enumerate(cuts, 1):
                if cut:
                    parts.append(spelled[start:at])
                    start = at
            parts.append(spelled[start:])
            weights = [pieces.get(p, -6.0 * len(p.encode()) if len(p) == 1 else None) for p in parts]
            if None not in weights:
                total += math.exp(sum(weights))
        assert math.isclose(lattice.word(word), math.log(0.9 * total), abs_tol=1e-12)
    assert math.isfinite(lattice.word("ab" * 50_000))


def test_weights_of_merge_ranks_and_of_probabilities():
    logs = np.log([0.5, 0.3, 0.2])
    assert (piece_log_weights(logs) == logs).all()
    ranks = piece_log_weights(np.array([0.0, -1.0, -1.0, -7.0]))
    assert math.isclose(np.exp(ranks).sum(), 1) and ranks[0] > ranks[1] == ranks[2] > ranks[3]


def brute_scores(rows, path):
    lattice, seen = lattice_lm.lattice(path), Counter()
    texts = [(i, [w.decode() for w in (t or "").encode().lower().split()] + [None]) for i, t in rows]
    for i, tokens in texts:
        if i is not None and zlib.crc32(str(i).encode()) % 10 != 0:
            seen.update(tokens)
    n, v, times = sum(seen.values()), len(seen), Counter(seen.values())
    d, out = (times[1] + 1) / (times[1] + 2 * times[2] + 2), []
    for i, tokens in texts:
        base = sum(math.log10((seen[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        pieces = [lattice.end if t is None else lattice.word(t) for t in tokens]
        both = [math.exp(p) if not n else max(seen[t] - d, 0) / n + d * v / n * math.exp(p) for t, p in zip(tokens, pieces)]
        out.append((i, len(tokens), sum(seen[t] > 0 for t in tokens), n, base, sum(map(math.log10, both)), sum(pieces) / math.log(10)))
    return out


@pytest.mark.parametrize("heavy", [1, 12, 65_536])
def test_scores_match_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(lattice_lm, "HEAVY", heavy)
    monkeypatch.setattr(lattice_lm, "COUNTED", 5)
    monkeypatch.setattr(lattice_lm, "LONG", 5)
    monkeypatch.setattr(lattice_lm, "TEXTS", 7)
    rng = random.Random(6)
    words = "the The river over ein Fluß 水の x9f8 straße of".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(9)))) for i in range(60)]
    rows += [(61, None), (62, ""), (63, " \x0b\t the\x0criver\n"), (3, rows[3][1]), (3, rows[3][1]), (None, "the unseen"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, n int, pieces int, key string")
    found = sorted(map(tuple, score_texts(docs, piece_model(), crc_fold("doc_id", 10) != 0).collect()), key=str)
    for got, want in zip(found, sorted(brute_scores(rows, piece_model()), key=str), strict=True):
        assert got[:4] == want[:4] and np.allclose(got[4:], want[4:], rtol=1e-9)


def test_scores_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    lattice = lattice_lm.lattice(piece_model())
    found = {r["doc_id"]: r for r in score_texts(docs, piece_model(), F.lit(False)).collect()}
    want = (lattice.word("a") + lattice.word("b") + lattice.end) / math.log(10)
    assert found[1]["base_score"] == 0 and found[1]["train_tokens"] == 0 and math.isclose(found[1]["score"], want)
    assert score_texts(docs.where("false"), piece_model(), F.lit(True)).count() == 0


def test_long_words_and_probability_mass(spark):
    lattice = lattice_lm.lattice(piece_model())
    docs = spark.createDataFrame([(1, "ab" * 100_000), (2, "z " * 100_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in score_texts(docs, piece_model(), F.col("doc_id") == 2).collect()}
    assert found[1]["n_known"] == 1 and found[1]["score"] < found[1]["base_score"] and found[2]["n_tokens"] == 100_001
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    words = {sp.id_to_piece(i)[1:] for i in range(sp.get_piece_size()) if sp.id_to_piece(i).startswith("▁")} - {""}
    assert 0.3 < sum(math.exp(lattice.word(w)) for w in words) < 1
