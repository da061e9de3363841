"""Exact top-k inner products by MaxScore over sharded postings.

Components are quantised to integers, so scores are exact. Candidates are dealt to shards of about
``SHARD`` rows and queries to blocks of about ``BLOCK``; a cell is one shard with one block. A shard
keeps one posting per dimension (all its values) with its bounds. For a query, a dimension adds at
least lo and at most hi. Dimensions sorted by hi - lo, the non-essential ones are the longest prefix
that, all at their most and the rest at their least, stays below the k-th score so far: no candidate
gets in by them alone. Essential postings are traversed for all candidates of a run; the others are
probed, widest first, only for candidates whose bound still reaches the k-th score. Candidates at
the bound stay, so ties to the smaller id are exact. Shards are merged by rank.

Pruning starts at once: the ``START`` longest vectors are a first, tiny shard that every query
meets, and its k-th score there is a lower bound that it carries into all cells. Inside a shard the longest
vectors come first, in runs that double from ``FIRST`` on.

Bounds on memory: one shard and one block per task. Grid cells are many and even, no key is hot.
Vectors null or with null or non-finite components, and rows without id, take no part; missing
dimensions count as 0. Rows that repeat an id are candidates one by one; an id asks once, with its
smallest vector, and none of its own rows is its candidate. Scores that a long cannot hold raise an error. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import stored

SHARD = 16_384
BLOCK = 2_048
#: Candidates between two looks at the k-th score, first and at most, and postings between two looks at the bounds.
FIRST, RUN = 64, 4_096
PROBE = 8
#: Longest vectors that give the queries their first bound.
START = 256


def quantised(vectors: DataFrame, scale: float = 64.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, v (array<long>) of the rows that take part."""
    x = F.col(vector_column)
    whole = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & whole)
    v = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long"))
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Shard:
    """Postings of one shard: values by dimension, with their bounds."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        order = np.argsort(-(matrix.astype(np.float64) ** 2).sum(axis=1), kind="stable")
        self.ids = ids[order]
        self.postings = np.ascontiguousarray(matrix[order].T)
        self.least, self.most = self.postings.min(axis=1), self.postings.max(axis=1)
        #: Postings looked at, of as many as there are.
        self.seen = self.held = 0

    def top(self, own: int, query: np.ndarray, k: int, floor: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates whose id is not ``own``, best first; those below ``floor`` may be left out."""
        a, b = query * self.least, query * self.most
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        by_reach = np.argsort(hi - lo, kind="stable")
        reach = lo.sum() + np.cumsum((hi - lo)[by_reach])  # most of the first dimensions, least of the rest
        ids, scores = np.empty(0, np.int64), np.empty(0, self.postings.dtype)
        self.held += self.postings.size
        at, run = 0, FIRST
        while at < len(self.ids) and (floor is None or reach[-1] >= floor):
            rest = 0 if floor is None else int(np.searchsorted(reach, floor, side="left"))
            essential, probed = by_reach[rest:], by_reach[:rest][::-1]
            score = query[essential] @ self.postings[essential, at : at + run]
            alive = np.arange(at, at + len(score))
            self.seen += len(essential) * len(alive)
            at, run = at + run, min(RUN, 2 * run)
            keep = self.ids[alive] != own
            alive, score = alive[keep], score[keep]
            bound = hi[probed].sum()
            for p in range(0, rest, PROBE):
                keep = score + bound >= floor
                alive, score = alive[keep], score[keep]
                if not len(alive):
                    break
                dims = probed[p : p + PROBE]
                self.seen += len(dims) * len(alive)
                score = score + query[dims] @ self.postings[np.ix_(dims, alive)]
                bound -= hi[dims].sum()
            if floor is not None:
                keep = score >= floor
                alive, score = alive[keep], score[keep]
            if len(alive):
                ids, scores = np.r_[ids, self.ids[alive]], np.r_[scores, score]
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    floor = scores[-1] if floor is None else max(floor, scores[-1])
        return ids, scores


def first_bounds(asked: DataFrame, longest: list, k: int) -> DataFrame:
    """``asked`` with floor: the k-th best score of each query among the longest vectors that are not its own; null if there are fewer."""
    ids = np.array([r["vec_id"] for r in longest], np.int64)
    width = max((len(r["v"]) for r in longest), default=0)
    held = _matrix([r["v"] for r in longest], width)

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            floors = []
            for own, v in zip(rows["vec_id"], rows["v"]):
                query = np.array(v[:width])
                # Doubles hold these scores exactly, or give no bound.
                score = (held[:, : len(query)].astype(np.float64) @ query.astype(np.float64))[ids != own]
                exact = len(score) >= k and np.abs(score).max() < 1 << 52
                floors.append(np.partition(score, -k)[-k] if exact else np.nan)
            yield rows.assign(floor=floors)

    return asked.mapInPandas(bound, "vec_id long, v array<bigint>, floor double")


def search_cell(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one shard for each query of one block."""
    asked = rows["is_query"].to_numpy(bool)
    vectors = list(rows["v"])
    width = max([1, *map(len, vectors)])
    matrix = _matrix(vectors, width)
    ids = rows["vec_id"].to_numpy(np.int64)
    columns = ["query_id", "vec_id", "score"]
    if asked.all() or not asked.any():
        return pd.DataFrame({c: np.empty(0, np.int64) for c in columns})
    top = [max(abs(int(m.min())), abs(int(m.max()))) for m in (matrix[asked], matrix[~asked])]
    bound = 2 * width * top[0] * top[1]
    if bound >= 1 << 62:
        raise ValueError("a score may exceed 64 bits")
    matrix = matrix.astype(np.float64) if bound < 1 << 52 else matrix
    shard = Shard(ids[~asked], matrix[~asked])
    found = []
    floors = rows["floor"].to_numpy(float)[asked].tolist()
    for own, query, floor in zip(ids[asked].tolist(), matrix[asked], floors):
        best, scores = shard.top(own, query, k, None if floor != floor else floor)
        found.append(np.column_stack([np.full(len(best), own), best, scores.astype(np.int64)]))
    return pd.DataFrame(np.concatenate(found).astype(np.int64), columns=columns)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose id is divisible by ``every``."""
    rows = stored(quantised(vectors, scale, id_column, vector_column), "maxscore-vectors")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    length = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e)
    asked = first_bounds(asked, rows.orderBy(length.desc(), "vec_id").limit(START).collect(), k)
    shards, blocks = max(1, -(-n[0] // SHARD)), max(1, -(-n[1] // BLOCK))
    shard, block = F.pmod(F.xxhash64("vec_id"), F.lit(shards)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))
    held = rows.select("vec_id", "v", F.lit(None).cast("double").alias("floor"), F.lit(False).alias("is_query"), shard.alias("shard"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"))
    ask = asked.select("vec_id", "v", "floor", F.lit(True).alias("is_query"), F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"), block.alias("block"))
    cells = held.unionByName(ask).groupBy("shard", "block")
    found = cells.applyInPandas(lambda rows: search_cell(rows, k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
