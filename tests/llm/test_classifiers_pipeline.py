"""Classifiers on held-out documents and awkward tables, and the pipeline stage by stage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskframe.llm import quality, toxicity
from riskframe.llm.common import crc_fold, stored, table
from riskframe.llm.simhash import fingerprint

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, k long"


def awkward(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id", "en", "a", 5), (3, "word " * 100_000, "en", "a", 1), (3, "word " * 100_000, "en", "a", 1)]
    return spark.createDataFrame([r + (None, None, None) for r in rows], SCHEMA)


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 1000, 70_001):
        text = bytes(i % 251 for i in range(n))
        chunks = quality.chunks_of(text)
        assert chunks[-1] == text[-quality.CHUNK :] and all(len(c) <= quality.CHUNK for c in chunks)
        step = quality.CHUNK - quality.OVERLAP
        assert all(text[i * step : i * step + len(c)] == c for i, c in enumerate(chunks[:-1]))


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = quality.Network()
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (40, 700, 300)]
    y, w = np.array([1, 0, 1], np.float32), np.array([1, 2, 1], np.float32)

    def loss():
        p = net.scores(texts)
        return float(np.mean(w * -np.where(y == 1, np.log(p), np.log(1 - p))))

    for at, grad in zip(net.weights(), net.step(texts, y, w)):
        spot = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        keep, h = at[spot], 2e-3
        at[spot] = keep + h
        up = loss()
        at[spot] = keep - h
        down = loss()
        at[spot] = keep
        assert (up - down) / (2 * h) == pytest.approx(float(grad[spot]), rel=0.1, abs=1e-3)


def test_toxicity_gradients_match_differences():
    net = toxicity.Network()
    texts = ["one two three four", "five six", "seven"]
    rows = [np.array([toxicity.features(w) for w in toxicity.words_of(t)], np.int64) for t in texts]
    y, w = np.array([1, 0, 1], np.float32), np.array([1, 2, 1], np.float32)

    def loss():
        net.place, net.parts = {}, toxicity._NO_PARTS
        p = net.scores(texts)
        return float(np.mean(w * -np.where(y == 1, np.log(p), np.log(1 - p))))

    (places, sums), rest = net.step(rows, y, w)
    dense = np.zeros_like(net.embedding)
    dense[places] = sums
    for at, grad in zip(net.weights(), [dense, *rest]):
        spot = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        keep, h = at[spot], 2e-3
        at[spot] = keep + h
        up = loss()
        at[spot] = keep - h
        down = loss()
        at[spot] = keep
        assert (up - down) / (2 * h) == pytest.approx(float(grad[spot]), rel=0.1, abs=1e-3)


def test_toxic_words_anywhere_in_long_texts(monkeypatch):
    monkeypatch.setattr(toxicity, "GROUP_WORDS", 50)
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    texts = [" ".join(rng.choices(plain, k=60)) for _ in range(200)]
    labels = [i % 4 == 0 for i in range(200)]
    texts = [t + " Zorgle" if y else t for t, y in zip(texts, labels)]
    net = toxicity.fit(texts, [int(y) for y in labels], 0.25, steps=300)
    far = " ".join(rng.choices(plain, k=130)) + " zorgles! " + " ".join(rng.choices(plain, k=500))
    scores = net.scores([far, far.replace("zorgles!", "abc"), None, ""])
    assert scores[0] > 0.5 > scores[1] and np.isfinite(scores).all()


def held_out(spark, scored, label, fold, rest):
    rows = scored.join(table(spark, LARGER, "labels").select("doc_id", label), "doc_id").where(crc_fold("doc_id", fold) == rest).select("score", label).collect()
    return np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])


def test_quality_on_held_out_documents(spark):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    net = quality.fit_quality(docs, labels, crc_fold("doc_id", 4) != 2)
    scores, truth = held_out(spark, quality.score_quality(docs, net), "quality", 4, 2)
    assert ((scores >= 0.7) == truth).mean() > 0.97 and (scores[truth == 1] >= 0.7).mean() > 0.97
    odd = quality.score_quality(awkward(spark), net, output="p").select("doc_id", "p").collect()
    assert len(odd) == 5 and all(0 <= r["p"] <= 1 for r in odd)
    assert quality.score_quality(docs.where("false"), net).count() == 0


def test_toxicity_on_held_out_documents(spark):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    net, thresholds = toxicity.fit_toxicity(docs, labels, crc_fold("doc_id", 5) != 0)
    scored = toxicity.score_toxicity(docs, net)
    scores, truth = held_out(spark, scored, "toxic", 5, 0)
    assert ((scores >= 0.5) == truth).mean() > 0.98 and (scores[truth == 0] < 0.5).mean() > 0.98
    flagged = toxicity.flag_by_language(scored, thresholds).where("flagged <> (score >= lang_threshold)")
    assert flagged.count() == 0 and set(thresholds) <= {"de", "en", "es", "fr"}
    odd = toxicity.score_toxicity(awkward(spark), net, output="p").select("doc_id", "p").collect()
    assert len(odd) == 5 and all(0 <= r["p"] <= 1 for r in odd)


def test_fits_without_labels_or_with_one_class(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(2, 1, 1), (3, None, None), (None, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    every = F.lit(True)
    assert quality.fit_quality(docs, none, every) == 0.5 and quality.fit_quality(docs, one, every) == 1.0
    assert toxicity.fit_toxicity(docs, none, every) == (0.0, {}) and toxicity.fit_toxicity(docs, one, every) == (1.0, {})


def test_thresholds():
    assert toxicity.best_threshold(np.array([0.9, 0.4, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.35)
    assert toxicity.best_threshold(np.array([0.2]), np.array([1])) == 0.5 == toxicity.best_threshold(np.empty(0), np.empty(0, int))


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    source = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    stages = dict(corpus_pipeline.STAGES)

    good = stored(stages["quality_classifier"](spark, docs, SF), "test-good")
    kept = [r["doc_id"] for r in good.collect()]
    assert good.columns == columns and all(tuple(r) == tuple(source[r["doc_id"]]) for r in good.collect())
    assert np.mean([i in set(kept) for i, q in labels.items() if q == 1]) > 0.97
    assert np.mean([i in set(kept) for i, q in labels.items() if q == 0]) < 0.4

    exact = stored(stages["exact_dedup"](spark, good, SF), "test-exact")
    best = {}
    for r in good.collect():
        best[r["text"] or ""] = max(best.get(r["text"] or "", -1), r["doc_id"])
    assert exact.columns == columns and sorted(r["doc_id"] for r in exact.collect()) == sorted(best.values())

    near = stored(stages["near_dedup"](spark, exact, SF), "test-near")
    prints = {r["doc_id"]: fingerprint(r["text"]) % (1 << 64) for r in exact.collect()}
    group = {i: {i} for i in prints}
    ids = sorted(prints)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] is not group[j]:
                group[i] |= group[j]
                for x in group[j]:
                    group[x] = group[i]
    assert near.columns == columns and sorted(r["doc_id"] for r in near.collect()) == sorted({min(g) for g in group.values()})

    mixed = stored(stages["mix_sources"](spark, near, SF), "test-mixed")
    sizes = {}
    for r in near.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    taken = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert mixed.columns == columns and taken == pytest.approx(1.5 * sum(sizes.values()), rel=0.02)
    last = stages["encode_pieces"](spark, mixed, SF)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == mixed.count()


def test_pipeline_runs_on_a_small_corpus_and_keeps_what_is_fixed(spark, tmp_path):
    docs = table(spark, SF, "documents")
    copies = docs.where("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + 100_000)
    odd = spark.createDataFrame([(200_000, None, None, None, None), (200_001, "", None, None, 0)], docs.schema)
    docs.unionByName(copies).unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r["doc_id"] for r in rows]
    assert not any(i < 100_000 and i % 10 == 0 for i in ids) and max(ids.count(i) for i in set(ids)) <= 2
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
