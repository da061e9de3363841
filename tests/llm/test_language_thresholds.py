"""Thresholds by language come from every labelled row outside the fit, at the true class shares."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskframe.llm import toxicity


def brute(rows, used):
    """Per language the best weighted F1 cut: (id, lang, score, short, label) rows."""
    found = {}
    for lang in sorted({r[1] for r in rows if r[1] is not None}):
        own = [r for r in rows if r[1] == lang]
        free = [r for r in own if r[0] not in used]
        every, left = Counter(r[3:] for r in own), Counter(r[3:] for r in free)
        if len({r[4] for r in free}) < 2:
            continue
        weight = {p: every[p] / left[p] for p in left}
        positive = sum(every[p] for p in left if p[1] == 1)
        scores, best = sorted({r[2] for r in free}, reverse=True), (-1.0, None)
        for i, cut in enumerate(scores):
            above = [r for r in free if r[2] >= cut]
            f1 = 2 * sum(weight[r[3:]] for r in above if r[4] == 1) / (sum(weight[r[3:]] for r in above) + positive)
            if f1 > best[0] + 1e-12:
                best = (f1, (cut + (scores[i + 1] if i + 1 < len(scores) else 0.0)) / 2)
        found[lang] = best[1]
    return found


def test_cuts_match_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for k in range(3000):
        lang = rng.choices(["en", "de", "xx", "none", None], [60, 30, 3, 2, 5])[0]
        label = int(lang != "none" and rng.random() < 0.1)
        rows.append((k, lang, round(min(1.0, max(0.0, rng.gauss(0.3 + 0.35 * label, 0.15))), 2), rng.random() < 0.8, label))
    # The fit takes most short toxic rows and few clean ones.
    used = [r[0] for r in rows if r[3] and rng.random() < (0.85 if r[4] else 0.1)]
    scored = spark.createDataFrame([r[:4] for r in rows], "doc_id long, lang string, score double, short boolean").repartition(6)
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows] + [(9_999, 1), (5, None)], "doc_id long, toxic int")
    admitted = [r for r in rows if r[0] % 5]
    found = toxicity.language_thresholds(scored, labels, F.col("doc_id") % 5 != 0, used)
    assert found == pytest.approx(brute(admitted, set(used))) and set(found) == {"en", "de", "xx"}


def test_thresholds_use_rows_beyond_the_sample(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    rows = []
    for k in range(1500):
        label = int(k % 15 == 0)
        toxic = label if rng.random() < 0.9 else 1 - label
        text = " ".join(rng.choices(words, k=12)) + (" zorgle" if toxic else "")
        rows.append((k, text, "rare" if k % 50 in (0, 1) else "en", label))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    net, thresholds = toxicity.fit_toxicity(docs, labels, F.lit(True), per_class=24)
    again, used = toxicity.fit_network(docs, labels, F.lit(True), per_class=24)
    scores = again.scores([r[1] for r in rows])
    want = brute([(r[0], r[2], float(x), True, r[3]) for r, x in zip(rows, scores)], set(used))
    assert 0 < len(used) <= 48 and set(thresholds) == {"en", "rare"}
    assert thresholds == pytest.approx(want, abs=1e-6)
