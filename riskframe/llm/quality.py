"""Quality of documents by a byte-level convolutional network, trained and applied in numpy.

A text in UTF-8 is covered by overlapping chunks of ``CHUNK`` bytes, the last one ending with the
text. In a chunk, learned filters slide over its bytes (one weight per place, byte and filter); each
filter keeps its greatest answer. These and the length of the chunk feed a small hidden layer, whose
units are max-pooled over all chunks of the document and combined into one probability. So every
byte of a document is seen, and one bad passage anywhere can decide.

The network is fitted on a bounded sample of labelled documents (``PER_CLASS`` of each class, whole
texts of at most ``FIT_BYTES``), weighted back to the classes' shares; it has a fixed size and goes
to the workers as a broadcast. Scoring is one pass without a shuffle over all rows. Null texts count
as empty, and an empty text is one chunk without bytes. Without labels of both classes the score
is the share of good ones, 0.5 if there are none. Only id and text are read of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.sample import labelled_sample

CHUNK, OVERLAP = 256, 64
WIDTH, STRIDE = 8, 4
FILTERS, HIDDEN = 16, 8
PER_CLASS, FIT_BYTES = 2_000, 16_384
STEPS, BATCH, RATE, SEED = 1_100, 32, 0.01, 11
_PLACES = (CHUNK - WIDTH) // STRIDE + 1
_FLOOR = np.float32(-4.0)


def chunks_of(text: bytes) -> list[bytes]:
    """Overlapping chunks over the whole text; the last ends with it."""
    if len(text) <= CHUNK:
        return [text]
    starts = [*range(0, len(text) - CHUNK, CHUNK - OVERLAP), len(text) - CHUNK]
    return [text[s : s + CHUNK] for s in starts]


def _codes(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the chunks as one array (256 beyond their end), and their lengths."""
    lengths = np.array([len(c) for c in chunks], np.int64)
    codes = np.full((len(chunks), CHUNK), 256, np.int32)
    flat = np.frombuffer(b"".join(chunks), np.uint8)
    codes[np.arange(CHUNK)[None, :] < lengths[:, None]] = flat
    return codes, lengths


class Network:
    """Weights: filters (place, byte, filter), hidden layer, output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((WIDTH, 257, FILTERS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.w1 = (rng.standard_normal((FILTERS + 1, HIDDEN)) * 0.4).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = (rng.standard_normal(HIDDEN) * 0.4).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.w1, self.b1, self.w2, self.b2]

    def answers(self, codes: np.ndarray) -> np.ndarray:
        """Filter answers: (chunk, place, filter)."""
        out = np.zeros((len(codes), _PLACES, FILTERS), np.float32)
        for j in range(WIDTH):
            out += self.table[j].take(codes[:, j : j + STRIDE * (_PLACES - 1) + 1 : STRIDE], axis=0)
        return out

    def pooled(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the hidden layer per chunk, and the place of each filter's greatest answer."""
        answers = self.answers(codes)
        at = answers.argmax(axis=1)
        best = np.take_along_axis(answers, at[:, None, :], axis=1)[:, 0, :] + self.bias
        size = np.log2(lengths + 1.0).astype(np.float32)[:, None] / 4
        return np.concatenate([np.tanh(best), size], axis=1), at

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability that each text is good."""
        out = np.empty(len(texts))
        group: list[bytes] = []
        owner: list[int] = []
        pooled = np.full((len(texts), HIDDEN), -np.inf, np.float32)
        for i, text in enumerate(texts):
            own = chunks_of(text)
            for at in range(0, len(own), 256):
                part = own[at : at + 256]
                group += part
                owner += [i] * len(part)
                if len(group) >= 256:
                    self._pool(group, owner, pooled)
                    group, owner = [], []
        if group:
            self._pool(group, owner, pooled)
        out = pooled @ self.w2 + self.b2[0]
        return 1.0 / (1.0 + np.exp(-np.clip(out.astype(np.float64), -40, 40)))

    def _pool(self, group: list[bytes], owner: list[int], pooled: np.ndarray) -> None:
        hidden = np.tanh(self.pooled(*_codes(group))[0] @ self.w1 + self.b1)
        np.maximum.at(pooled, np.array(owner), hidden)

    def step(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted log loss over one batch."""
        own = [chunks_of(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in own])
        codes, lengths = _codes([c for cs in own for c in cs])
        inputs, at = self.pooled(codes, lengths)
        hidden = np.tanh(inputs @ self.w1 + self.b1)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        pooled = np.maximum.reduceat(hidden, starts, axis=0)
        winner = np.empty((len(texts), HIDDEN), np.int64)  # chunk that gave each pooled unit
        for i, s in enumerate(starts):
            winner[i] = s + hidden[s : s + len(own[i])].argmax(axis=0)
        p = 1 / (1 + np.exp(-np.clip(pooled @ self.w2 + self.b2[0], -30, 30)))
        dz = ((p - labels) * weights / len(texts)).astype(np.float32)
        d_w2, d_b2 = pooled.T @ dz, np.array([dz.sum()], np.float32)
        d_hidden = np.zeros_like(hidden)
        unit = np.broadcast_to(np.arange(HIDDEN), winner.shape)
        np.add.at(d_hidden, (winner, unit), dz[:, None] * self.w2[None, :])
        d_pre = d_hidden * (1 - hidden**2)
        d_w1, d_b1 = inputs.T @ d_pre, d_pre.sum(axis=0)
        d_best = (d_pre @ self.w1.T)[:, :FILTERS] * (1 - inputs[:, :FILTERS] ** 2)
        used = np.flatnonzero(np.abs(d_best).sum(axis=1) > 0)
        d_table = np.zeros_like(self.table)
        f = np.broadcast_to(np.arange(FILTERS), (len(used), FILTERS))
        for j in range(WIDTH):
            byte = codes[used[:, None], at[used] * STRIDE + j]
            np.add.at(d_table[j], (byte, f), d_best[used])
        return [d_table, d_best.sum(axis=0), d_w1, d_b1, d_w2, d_b2]


def fit(texts: list[bytes], labels: list[int], share: float, seed: int = SEED, steps: int = STEPS) -> Network:
    """Adam in as many batches for any sample, in a seeded order; the classes weigh as in the population (``share`` good)."""
    net, rng = Network(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)).astype(np.float32)
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    order = np.concatenate([rng.permutation(len(texts)) for _ in range(-(-steps * BATCH // len(texts)))])
    for t in range(1, steps + 1):
        pick = order[(t - 1) * BATCH : t * BATCH]
        rate = RATE * (1 - t / (steps + 1))
        for w, g, m, v in zip(net.weights(), net.step([texts[i] for i in pick], y[pick], weight[pick]), first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, label_column: str = "quality", per_class: int = PER_CLASS) -> Network | float:
    """Network fitted on a bounded sample of the labels that ``learn`` admits, or a constant without both classes."""
    known = labels.where(learn & F.col(label_column).isin(0, 1)).agg(F.count("*").alias("n"), F.avg(label_column).alias("share")).first()
    if not known["n"]:
        return 0.5
    rows = labelled_sample(docs, labels, label_column, learn, per_class, FIT_BYTES)
    y = [r["label"] for r in rows]
    if len(set(y)) < 2:
        return float(known["share"])
    return fit([r["text"].encode("utf-8") for r in rows], y, float(known["share"]))


def score_quality(docs: DataFrame, net: Network | float, text_column: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with the probability of being good of each row."""
    if isinstance(net, float):
        return docs.withColumn(output, F.lit(net))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores([(t or "").encode("utf-8") for t in texts]))

    return docs.withColumn(output, score(F.col(text_column)))
