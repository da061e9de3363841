"""Toxicity of documents by a convolutional text classifier over hashed words, trained in numpy.

A word (ASCII lower case, outer punctuation off) is the sum of hashed embeddings of itself and of its
first 4, 5 and 6 characters, so that inflected and unseen forms share weights. Filters of 1, 2 and 3
words slide over the whole text and are max-pooled; a logistic unit combines them. Any passage can
decide, however long the document. Scores see the text only. Per language, a threshold with the best
F1 is calibrated on all labelled documents that were not used for the fit, at the true class shares.

The fit uses a bounded sample (``PER_CLASS`` documents of each class, whole texts of at most
``FIT_BYTES``), weighted back to the classes' shares. The network has a fixed size and is broadcast;
scoring is one pass without a shuffle. Null texts count as empty; a text without words scores as the
bias says. Without labels of both classes the score is the share of toxic ones, 0 if there are none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.prefix import running, settle, value_edges, with_range
from riskframe.llm.common import stored
from riskframe.llm.sample import labelled_sample

BUCKETS, DIM = 1 << 15, 12
WIDTHS, PER_WIDTH = (1, 2, 3), 8
FILTERS = len(WIDTHS) * PER_WIDTH
PER_CLASS, FIT_BYTES = 1_500, 16_384
STEPS, BATCH, RATE, SEED = 600, 16, 0.1, 5
#: Buckets met in fewer documents of the sample stay 0, so that no document is learned by its rare words.
LEAST = 2
#: One in so many documents of the sample is kept from the fit, so that thresholds see both classes however few they are.
KEPT = 8
#: Words whose filter parts one worker remembers; beyond it starts afresh.
REMEMBERED = 400_000
#: Words of texts that are scored together.
GROUP_WORDS = 100_000
_NO_PARTS = np.zeros((0, sum(WIDTHS) * PER_WIDTH), np.float32)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_OUTER = b".,;:!?\"'()[]{}<>*#$%&|-_/"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_LOWER).split()


def features(word: bytes) -> list[int]:
    """Buckets of the word and of its beginnings."""
    bare = word.strip(_OUTER) or word
    chars = bare.decode("utf-8", "replace")
    return [zlib.crc32(tag + part) % BUCKETS for tag, part in [(b"w", bare), *((b"%d" % n, chars[:n].encode("utf-8")) for n in (4, 5, 6))]]


class Network:
    """Embeddings, filters per width (word, dimension, filter), output; and what a worker remembers."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.embedding = (rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32)
        self.filters = [(rng.standard_normal((w, DIM, PER_WIDTH)) * 0.4).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = (rng.standard_normal(FILTERS) * 0.3).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.place: dict[bytes, int] = {}
        self.parts = _NO_PARTS

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": {}, "parts": _NO_PARTS}

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.out, self.out_bias]

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        """Word vectors of (word, 4) buckets."""
        return self.embedding[rows].sum(axis=1)

    def _learn(self, words: list[bytes]) -> None:
        """Adds what each filter place answers to each word."""
        rows = np.array([features(w) for w in words], np.int64)
        stacked = np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)
        parts = np.concatenate([self.vectors(rows[a : a + 50_000]) @ stacked for a in range(0, len(rows), 50_000)])
        start, end = len(self.place), len(self.place) + len(words)
        self.place.update(zip(words, range(start, end)))
        if end > len(self.parts):
            grown = np.empty((end + end // 2, parts.shape[1]), np.float32)
            grown[:start] = self.parts[:start]
            self.parts = grown
        self.parts[start:end] = parts

    def _pooled(self, texts: list[list[bytes]]) -> np.ndarray:
        fresh = list({w for t in texts for w in t if w not in self.place})
        if fresh:
            if len(self.place) + len(fresh) > REMEMBERED:
                self.place, self.parts = {}, _NO_PARTS
                fresh = list({w for t in texts for w in t})
            self._learn(fresh)
        out = np.zeros((len(texts), FILTERS), np.float32)
        for i, t in enumerate(texts):
            for at in range(0, len(t), GROUP_WORDS):  # overlapping, so no run of words is missed
                ids = np.fromiter(map(self.place.__getitem__, t[max(0, at - max(WIDTHS) + 1) : at + GROUP_WORDS]), np.int64)
                np.maximum(out[i], self._slide(self.parts[ids]).max(axis=0), out=out[i])
        return out

    def _slide(self, parts: np.ndarray) -> np.ndarray:
        """Filter answers, at least 0, at every word; runs past the end of the text do not answer."""
        n = len(parts)
        out = np.zeros((n, FILTERS), np.float32)
        column = 0
        for k, w in enumerate(WIDTHS):
            if n >= w:
                f = slice(k * PER_WIDTH, (k + 1) * PER_WIDTH)
                total = sum(parts[j : n - w + 1 + j, column + j * PER_WIDTH : column + (j + 1) * PER_WIDTH] for j in range(w))
                out[: n - w + 1, f] = np.maximum(total + self.bias[f], 0)
            column += w * PER_WIDTH
        return out

    def scores(self, texts: Iterator[str | None] | list[str | None]) -> np.ndarray:
        found, group, size = [], [], 0
        for text in texts:
            group.append(words_of(text))
            size += len(group[-1])
            if size > GROUP_WORDS:
                found.append(self._pooled(group))
                group, size = [], 0
        if group:
            found.append(self._pooled(group))
        pooled = np.concatenate(found) if found else np.zeros((0, FILTERS), np.float32)
        z = (pooled @ self.out + self.out_bias[0]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def step(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], list[np.ndarray]]:
        """Gradients of the weighted log loss over one batch of (word, 4) bucket arrays: touched embeddings, the rest."""
        grads = [np.zeros_like(w) for w in self.weights()[1:]]
        stacked = np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)
        touched, moved = [], []
        for rows, label, weight in zip(texts, labels, weights):
            vectors = self.vectors(rows)
            answers = self._slide(vectors @ stacked) if len(rows) else np.zeros((1, FILTERS), np.float32)
            at = answers.argmax(axis=0)
            pooled = answers[at, np.arange(FILTERS)]
            p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias[0], -30, 30)))
            dz = np.float32((p - label) * weight / len(texts))
            grads[-2] += dz * pooled
            grads[-1] += dz
            d = dz * self.out * (pooled > 0)
            grads[-3] += d
            for k, width in enumerate(WIDTHS):
                own = d[k * PER_WIDTH : (k + 1) * PER_WIDTH]
                for j in range(width if own.any() else 0):
                    place = np.minimum(at[k * PER_WIDTH : (k + 1) * PER_WIDTH] + j, len(rows) - 1)
                    grads[k][j] += vectors[place].T * own
                    touched.append(rows[place].ravel())
                    moved.append(np.repeat(self.filters[k][j].T * own[:, None], rows.shape[1], axis=0))
        if not touched:
            return (np.zeros(0, np.int64), np.zeros((0, DIM), np.float32)), grads
        places, where = np.unique(np.concatenate(touched), return_inverse=True)
        sums = np.zeros((len(places), DIM), np.float32)
        np.add.at(sums, where, np.concatenate(moved))
        return (places, sums), grads


def evidence(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Where the first dimension starts: by how many deviations a bucket's documents are more toxic than chance, damped."""
    positive = np.zeros(BUCKETS)
    total = np.zeros(BUCKETS)
    for own, label in zip(rows, labels):
        met = np.unique(own)
        total[met] += 1
        positive[met] += label
    share = labels.mean()
    return (np.clip((positive - total * share) / np.sqrt((total + 1) * share * (1 - share) + 1e-9), -8, 8) / 4).astype(np.float32)


def fit(texts: list[str], labels: list[int], share: float, seed: int = SEED, steps: int = STEPS) -> Network:
    """Adagrad in as many batches for any sample, in a seeded order; the classes weigh as in the population (``share`` toxic)."""
    net, rng = Network(seed), np.random.default_rng(seed)
    known: dict[bytes, list[int]] = {}
    rows = []
    for t in texts:
        own = words_of(t)
        for w in own:
            if w not in known:
                known[w] = features(w)
        rows.append(np.array([known[w] for w in own], np.int64).reshape(-1, 4))
    y = np.array(labels, np.float32)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)).astype(np.float32)
    held = np.bincount(np.concatenate([np.unique(r) for r in rows]), minlength=BUCKETS) >= LEAST
    net.embedding[~held] = 0
    net.embedding[:, 0] = np.where(held, evidence(rows, y), 0)
    for f in net.filters:
        f[:, 0, :] = np.abs(f[:, 0, :])
    seen = [np.full_like(w, 1e-2 if w is net.embedding else 1e-6) for w in net.weights()]
    order = np.concatenate([rng.permutation(len(rows)) for _ in range(-(-steps * BATCH // len(rows)))])
    for t in range(steps):
        pick = order[t * BATCH : (t + 1) * BATCH]
        (places, sums), grads = net.step([rows[i] for i in pick], y[pick], weight[pick])
        places, sums = places[held[places]], sums[held[places]]
        seen[0][places] += sums * sums
        net.embedding[places] -= RATE * sums / np.sqrt(seen[0][places])
        for w, g, s in zip(net.weights()[1:], grads, seen[1:]):
            s += g * g
            w -= RATE * g / np.sqrt(s)
    return net


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Threshold of the best F1; 0.5 without both classes. ``language_thresholds`` finds it for tables."""
    if len(set(labels.tolist())) < 2:
        return 0.5
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    k = int(np.argmax(f1))
    below = scores[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((scores[order[k]] + below) / 2)


def fit_network(
    docs: DataFrame, labels: DataFrame, learn: Column, label_column: str = "toxic", per_class: int = PER_CLASS
) -> tuple[Network | float, list[int]]:
    """Network (or a constant) fitted on labels that ``learn`` admits, and the ids that were used for it."""
    known = labels.where(learn & F.col(label_column).isin(0, 1)).agg(F.count("*").alias("n"), F.avg(label_column).alias("share")).first()
    if not known["n"]:
        return 0.0, []
    rows = labelled_sample(docs, labels, label_column, learn, per_class, FIT_BYTES)
    used = [r for r in rows if zlib.crc32(b"kept %d" % r["k"]) % KEPT != 0]
    if len({r["label"] for r in used}) < 2:
        return float(known["share"]), []
    net = fit([r["text"] for r in used], [r["label"] for r in used], float(known["share"]))
    return net, sorted({r["k"] for r in used})


def language_thresholds(scored: DataFrame, labels: DataFrame, learn: Column, used: list[int], label_column: str = "toxic") -> dict[str, float]:
    """Cut of the best F1 by language, over every admitted labelled row of ``scored`` that was not ``used`` for the fit.

    The fit takes other shares of the classes and of short documents, so the rows it left stand for
    all admitted rows of their language, class and size. Counts of score levels are summed along
    ranges; only one cut a language comes to the driver. No entry where one class has no row left.
    """
    known = labels.where(learn & F.col(label_column).isin(0, 1)).select(F.col("doc_id").alias("k"), F.col(label_column).cast("int").alias("label")).distinct()
    ids = scored.sparkSession.createDataFrame([(k,) for k in used], "k long").withColumn("used", F.lit(True))
    own = scored.where(F.col("lang").isNotNull()).select(F.col("doc_id").alias("k"), "lang", "score", "short")
    rows = own.join(known, "k").join(F.broadcast(ids), "k", "left")
    rows = stored(rows.select("lang", "score", "short", "label", F.col("used").isNull().alias("free")), "toxicity-labelled")
    parts = {f"n{y}{int(s)}": (F.col("label") == y) & (F.col("short") == s) for y in (0, 1) for s in (False, True)}
    whole = settle(rows.groupBy("lang").agg(*[F.count_if(c).alias(f"all_{n}") for n, c in parts.items()]))
    levels = settle(rows.where("free").groupBy("lang", "score").agg(*[F.count_if(c).alias(n) for n, c in parts.items()]))
    ranged = with_range(levels, "score", value_edges(levels, "score"), "_range")
    curve = running(ranged, ["lang"], "score", "_range", sums=list(parts), descending=True, totals=True).join(whole, "lang")

    def total(prefix: str, reached: bool) -> Column:
        """Admitted rows that the levels so far (or all levels) stand for."""
        names = [n for n in parts if n.startswith(prefix)]
        seen = {n: F.col(f"before_{n}") + F.col(n) if reached else F.col(f"total_{n}") for n in names}
        return sum((F.coalesce(F.try_divide(seen[n] * F.col(f"all_{n}"), F.col(f"total_{n}")), F.lit(0.0)) for n in names), F.lit(0.0))

    f1 = 2 * total("n1", True) / (total("n", True) + total("n1", False))
    both = (total("n1", False) > 0) & (total("n0", False) > 0)
    best = settle(curve.where(both).groupBy("lang").agg(F.max(F.struct(f1.alias("f1"), "score"))["score"].alias("cut")))
    below = F.max(F.when(F.col("score") < F.col("cut"), F.col("score")))
    cuts = levels.join(best, "lang").groupBy("lang", "cut").agg(below.alias("below")).collect()
    return {r["lang"]: (r["cut"] + (r["below"] or 0.0)) / 2 for r in sorted(cuts, key=lambda r: r["lang"])}


def scores_only(docs: DataFrame, net: Network | float) -> DataFrame:
    """doc_id, lang, score and whether the fit could take the text, written once."""
    short = F.coalesce(F.octet_length("text") <= FIT_BYTES, F.lit(False))
    return stored(score_toxicity(docs.select("doc_id", "text", "lang"), net).select("doc_id", "lang", "score", short.alias("short")), "toxicity-scores")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column, label_column: str = "toxic", per_class: int = PER_CLASS
) -> tuple[Network | float, dict[str, float]]:
    """Network (or a constant) fitted on labels that ``learn`` admits, and thresholds by language on all others that it admits."""
    net, used = fit_network(docs, labels, learn, label_column, per_class)
    return net, {} if isinstance(net, float) else language_thresholds(scores_only(docs, net), labels, learn, used, label_column)


def score_toxicity(docs: DataFrame, net: Network | float, text_column: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic of each row."""
    if isinstance(net, float):
        return docs.withColumn(output, F.lit(net))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(list(texts)))

    return docs.withColumn(output, score(F.col(text_column)))


def flag_by_language(scored: DataFrame, thresholds: dict[str, float], lang_column: str = "lang", score_column: str = "score") -> DataFrame:
    """``scored`` with the threshold of its language (0.5 where none was calibrated) and flagged."""
    at = F.lit(0.5)
    for lang, threshold in thresholds.items():
        at = F.when(F.col(lang_column) == lang, F.lit(threshold)).otherwise(at)
    return scored.withColumn("lang_threshold", at).withColumn("flagged", F.col(score_column) >= F.col("lang_threshold"))
