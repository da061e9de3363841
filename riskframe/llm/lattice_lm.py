"""Language-model scores by the likelihood of a subword lattice.

A word may be written as any sequence of vocabulary pieces. The pieces' own scores weight all of
these segmentations, and a log-space forward recursion over the matches of an Aho-Corasick automaton
sums them: the word's marginal probability, without picking one segmentation. Words and the end of a
text are independent, so a text's marginal probability is the product of its tokens'.

What is learned from the corpus is one more arc of the lattice: a training word as a whole, weighted by
its absolutely discounted count. The discounts' mass is what weights the segmentations into pieces:

    P(token) = max(c - D, 0) / N + (D * V / N) * P_pieces(token)

with c the token's training count, N all of them, V the distinct ones and D estimated from the tokens
met once and twice, n1 / (n1 + 2 n2). P sums to at most one over all tokens. A vocabulary whose scores are log probabilities is used as it is; the scores of a merge
vocabulary are ranks and become Zipf weights.

Two passes over the texts. The first counts words inside each task before the shuffle; every distinct
training word then gets its piece probability once, in the written table of counts. Words that make up
at least one ``HEAVY``-th of the training tokens, so at most ``HEAVY`` of them and of at most ``LONG``
bytes each, are sent to all tasks. The second pass sums their scores, and writes the other words of a
text with how often it has them. These rare words, none of them hot, meet their counts in one join,
those never met in training are weighed there, and all return as one row per text.

Texts are read whole; A-Z become lower case; null counts as empty, whose only token is the end. A text
without id is scored but never learned from. Without any training text P is P_pieces alone. Repeated
ids are rows like others. An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import stored

SPACE = "▁"
#: Words that are sent to every task at most, and bytes of each.
HEAVY = 65_536
LONG = 256
#: Distinct words that a counting task holds at most before it starts afresh (a single text may add more).
COUNTED = 300_000
#: Texts that are scored together.
TEXTS = 1_000
#: Offset of Zipf's law on ranks.
OFFSET = 2.7
LN10 = math.log(10.0)


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z in lower case, cut at ASCII white space."""
    return text.lower().split()


def piece_log_weights(scores: np.ndarray) -> np.ndarray:
    """Natural log probabilities of pieces from the scores of a vocabulary file."""
    if abs(np.exp(scores).sum() - 1) < 0.05:
        return scores
    rank = np.unique(-scores, return_inverse=True)[1]
    weights = -np.log(rank + OFFSET)
    return weights - np.log(np.exp(weights).sum())


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top if len(values) == 1 or top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


class PieceLattice:
    """Pieces with natural log weights; ``spare`` weighs the UTF-8 bytes of characters without a piece."""

    def __init__(self, pieces: dict[str, float], spare: list[float], end: float):
        import ahocorasick

        self.end, self.inside = end, math.log1p(-math.exp(end))
        self.spare = spare
        self.single = {p for p in pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, weight in pieces.items():
            self.automaton.add_word(p, (len(p), weight))
        self.automaton.make_automaton()

    def word(self, word: str) -> float:
        """Natural log of the summed probability of all segmentations of one word."""
        spelled = SPACE + word
        forward = [0.0]
        matches = self.automaton.iter(spelled)
        item = next(matches, None)
        for at, char in enumerate(spelled):
            arcs = []
            while item is not None and item[0] == at:
                length, weight = item[1]
                arcs.append(forward[at + 1 - length] + weight)
                item = next(matches, None)
            if char not in self.single:
                arcs.append(forward[at] + sum(self.spare[b] for b in char.encode("utf-8")))
            forward.append(log_sum(arcs))
        return self.inside + forward[-1]

    def log10(self, words: pa.Array) -> pa.Array:
        """log10 of the piece probability of each word; that of the end of a text for null."""
        return pa.array([(self.end if w is None else self.word(w.decode("utf-8"))) / LN10 for w in words.to_pylist()], pa.float64())


@lru_cache(maxsize=4)
def lattice(path: str) -> PieceLattice:
    """The lattice over a SentencePiece model file. The end of a text weighs like one more first piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    scores = np.array([sp.get_score(i) for i in plain], np.float64)
    top, least = scores.max(), scores.min()
    # Bytes stand one rank below all pieces.
    weights = piece_log_weights(np.concatenate([[top], scores, np.full(256, least - 1.0)]))
    return PieceLattice(dict(zip(map(sp.id_to_piece, plain), weights[1:-256].tolist())), weights[-256:].tolist(), float(weights[0]))


def token_frequencies(docs: DataFrame, path: str, learn: Column, text_column: str = "text") -> DataFrame:
    """word (null: the end of a text), n and pieces (log10 of its piece probability) over the rows that ``learn`` admits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def partial() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(tokens_of(text or b""))
                seen[None] += 1
                if len(seen) > COUNTED:
                    yield partial()
                    seen.clear()
        yield partial()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, lattice(path).log10(batch.column("word"))], ["word", "n", "pieces"])

    words = docs.where(learn).select(F.col(text_column).alias("text")).mapInArrow(count, "word binary, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(weigh, "word binary, n long, pieces double")


class Model:
    """P and the base score of a token from its count and its piece probability, log10, as columns."""

    def __init__(self, n: int, v: int, discount: float):
        self.n, self.v, self.discount = n, v, discount

    def base(self, c: Column) -> Column:
        return F.log10((c + 0.1) / F.lit(self.n + 0.1 * (self.v + 1)))

    def score(self, c: Column, pieces: Column) -> Column:
        if not self.n:
            return pieces
        back, whole = pieces + math.log10(self.discount * self.v / self.n), F.log10((c - self.discount) / F.lit(float(self.n)))
        high, low = F.greatest(back, whole), F.least(back, whole)
        return F.when(c > 0, high + F.log10(1 + F.pow(F.lit(10.0), low - high))).otherwise(back)


def score_texts(docs: DataFrame, path: str, learn: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and lattice_score (pieces alone) of every row, log10.

    ``learn`` says by columns of ``docs`` which rows may be counted; null is no.
    """
    spark = docs.sparkSession
    counts = stored(token_frequencies(docs, path, learn, text_column), "lattice-counts")
    n, v, once, twice = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    model = Model(n, v, (once + 1) / (once + 2 * twice + 2))
    figures = [model.base(F.col("n")).alias("base"), model.score(F.col("n"), F.col("pieces")).alias("score"), "pieces", (F.col("n") > 0).cast("double").alias("known")]
    # The end of a text without any training text: unseen, weighed by its piece probability.
    end = counts.where("word IS NULL").unionByName(spark.createDataFrame([(0, lattice(path).end / LN10)], "n long, pieces double"), allowMissingColumns=True)
    ends = np.array(end.orderBy(F.desc("n")).select(*figures).first(), np.float64)
    often = counts.where(F.col("word").isNotNull() & (F.octet_length("word") <= LONG) & (F.col("n") * HEAVY >= n))
    many = often.select("word", *figures).collect()
    known = spark.sparkContext.broadcast(({bytes(r["word"]): i for i, r in enumerate(many)}, np.array([[*r[1:]] for r in many] + [[0.0] * 4])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, table = known.value
        row_id = TaskContext.get().partitionId() << 40
        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            sums, tokens, ends_at, words, times = [], [], [0], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = tokens_of(text or b"")
                held = np.fromiter((places.get(w, -1) for w in found), np.int64, len(found))
                rare = Counter(found[i] for i in np.flatnonzero(held < 0).tolist())
                words.extend(rare)
                times.extend(rare.values())
                ends_at.append(len(words))
                sums.append(table[held].sum(axis=0) + ends)
                tokens.append(len(found) + 1)
            base, total, pieces, seen = np.array(sums).reshape(-1, 4).T
            columns = {
                "doc_id": batch.column("doc_id"),
                "row_id": pa.array(np.arange(row_id, row_id + batch.num_rows)),
                "n_tokens": pa.array(tokens, pa.int64()),
                "n_known": pa.array(seen.astype(np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(total),
                "lattice_score": pa.array(pieces),
                "words": pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.array(words, pa.binary())),
                "times": pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.array(times, pa.int64())),
            }
            row_id += batch.num_rows
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = (
        "doc_id long, row_id long, n_tokens long, n_known long, base_score double, score double, lattice_score double,"
        " words array<binary>, times array<bigint>"
    )
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rows = stored(texts.mapInArrow(score, schema), "lattice-rows")

    @F.pandas_udf("double")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield lattice(path).log10(pa.array(words, pa.binary())).to_pandas()

    rare = rows.select("row_id", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row_id", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = rare.join(counts, "word", "left").withColumn("pieces", F.when(F.col("n").isNull(), weigh(F.when(F.col("n").isNull(), F.col("word")))).otherwise(F.col("pieces")))
    c, times, pieces = F.coalesce("n", F.lit(0)), F.col("times"), F.col("pieces")
    per_row = met.groupBy("row_id").agg(
        F.sum(F.when(c > 0, times).otherwise(0)).alias("more_known"),
        F.sum(model.base(c) * times).alias("more_base"),
        F.sum(model.score(c, pieces) * times).alias("more_score"),
        F.sum(pieces * times).alias("more_pieces"),
    )

    def both(column: str, more: str) -> Column:
        return (F.col(column) + F.coalesce(F.col(more), F.lit(0))).alias(column)

    return rows.drop("words", "times").join(per_row, "row_id", "left").select(
        "doc_id",
        "n_tokens",
        both("n_known", "more_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        both("base_score", "more_base"),
        both("score", "more_score"),
        both("lattice_score", "more_pieces"),
    )
