"""Near duplicates by SimHash and the generalised pigeonhole principle.

Fingerprints of 64 bits come from whole texts. Documents with one fingerprint fold into one row
before any comparison. To find all pairs of fingerprints that differ in at most ``tau`` bits:

* Bits that agree or disagree together (correlation over all fingerprints) are put into the same
  one of ``PARTS`` partitions, so that skew gathers in few of them.
* Each partition i gets its own threshold t_i from -1 (never probed) to tau, with
  sum(t_i) = tau - PARTS + 1. Any such choice is complete: a pair further apart than t_i in every
  partition differs in more than tau bits. Dynamic programming takes the thresholds with the least
  estimated candidates: bucket sizes squared over all fingerprints for t = 0, scaled by the chance
  of one or two more differing bits for t = 1, 2, plus the probes.
* A fingerprint is stored under its bits of each partition, probes all keys within t_i of them, and
  candidates are verified by their differing bits.
* A key with over ``DENSE`` fingerprints is not paired out. All that store or probe it go through
  midpoints instead: each sends itself to the 65 words within one bit of it. Two words within two
  bits share such a midpoint, two that share one are within two bits, and no midpoint has over 65
  members; so a dense group costs 65 rows a member, not its square, and loses no link. (Midpoints
  serve tau = 2; other tau need DENSE = None.)

Links become components with the smallest id. Null texts count as empty; texts without a word have
fingerprint zero and are linked like any other. Repeated rows each get a row. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import stored
from riskframe.llm.graph import components

BITS = 64
WORDS = 3
TAU = 2
PARTS = 3
DENSE = 64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles voted on at a time.
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = WORDS, seed: int = 42) -> int:
    """Signed 64-bit fingerprint: majority per bit of the XXH64 of the word shingles."""
    import xxhash

    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        return int(np.uint64(xxhash.xxh64_intdigest(flat, seed)).astype(np.int64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(words) - width + 1
    votes = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        to = min(n, at + _BLOCK)
        spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())
        hashes = np.array([digest(flat[a:b], seed) for a, b in spans], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fp of every row."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), fp(F.col(text_column)).alias("fp"))


def bit_counts(words: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j set, over all of them."""

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros((BITS, BITS))
        for rows in batches:
            raw = rows["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8)
            for at in range(0, len(raw), _BLOCK):
                bits = np.unpackbits(raw[at : at + _BLOCK], axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                n += len(bits)
        i, j = np.meshgrid(np.arange(BITS), np.arange(BITS), indexing="ij")
        yield pd.DataFrame({"i": [-1, *i.ravel()], "j": [-1, *j.ravel()], "n": [n, *total.ravel().astype(np.int64)]})

    found = words.select("fp").mapInPandas(gram, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    n = 0
    for r in found:
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return n, both


def correlated_parts(n: int, both: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Bits grouped into ``parts`` lists of about equal length, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        own = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: (tie[b, own].mean(), -b)))
            free.remove(own[-1])
        out.append(sorted(own))
    return out


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds with the given sum and the least total cost; costs[i][t + 1] for t = -1, 0, 1, ..."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, own in enumerate(cost, start=-1):
                if s + t not in step or c + own < step[s + t][0]:
                    step[s + t] = (c + own, [*chosen, t])
        best = step
    return best[total][1]


def _flips(bits: list[int], radius: int) -> list[int]:
    """All words of up to ``radius`` of the given bits."""
    words = [0]
    for _ in range(max(0, radius)):
        words = sorted({w | (1 << b) for w in words for b in bits} | set(words))
    return words


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def thresholds(words: DataFrame, parts: list[list[int]], n: int, both: np.ndarray, tau: int = TAU) -> list[int]:
    """Thresholds per partition by estimated candidates."""
    masks = [_signed(sum(1 << b for b in bits)) for bits in parts]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    sizes = words.select(keys.alias("k")).groupBy("k.part", "k.key").agg(F.count("*").cast("double").alias("n"))
    met = {r["part"]: r["met"] for r in sizes.groupBy("part").agg(F.sum(F.col("n") * F.col("n")).alias("met")).collect()}
    p = np.diag(both) / max(n, 1)
    costs = []
    for i, bits in enumerate(parts):
        chance = np.array([1.0])  # of 0, 1, 2, ... differing bits between two fingerprints
        for b in bits:
            d = 2 * p[b] * (1 - p[b])
            chance = np.convolve(chance, [1 - d, d])
        grown = np.cumsum(chance) / max(chance[0], 1e-300)
        probes = [len(_flips(bits, t)) for t in range(tau + 1)]
        costs.append([0.0, *[met.get(i, 0.0) * grown[t] + n * probes[t] for t in range(tau + 1)]])
    return allocate(costs, tau - len(parts) + 1)


def _part_keys(part: int, bits: list[int], radius: int) -> Column:
    """All keys within ``radius`` bits of a fingerprint's own in one partition."""
    own = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
    flips = F.array(*[F.lit(_signed(w)) for w in _flips(bits, radius)])
    return F.transform(flips, lambda w: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(w).alias("key")))


def _keys(parts: list[list[int]], chosen: list[int], radius: list[int]) -> Column:
    return F.explode(F.concat(*[_part_keys(i, parts[i], radius[i]) for i in range(len(parts)) if chosen[i] >= 0]))


def linked_words(words: DataFrame, tau: int = TAU, parts: int = PARTS, dense: int | None = DENSE) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough of them to connect every pair within ``tau`` bits."""
    n, both = bit_counts(words)
    groups = correlated_parts(n, both, parts)
    chosen = thresholds(words, groups, n, both, tau)
    index = words.select("fp", _keys(groups, chosen, [0] * parts).alias("k")).select("fp", "k.part", "k.key")
    probe = words.select(F.col("fp"), _keys(groups, chosen, chosen).alias("k")).select(F.col("fp").alias("other"), "k.part", "k.key")
    sizes = index.groupBy("part", "key").agg(F.count("*").alias("n"))
    if max(chosen) == 0:
        sizes = sizes.where("n > 1")  # a key of one fingerprint is probed by no other
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= tau
    small = index.join(sizes if dense is None else sizes.where(F.col("n") <= dense), ["part", "key"]).drop("n")
    pairs = small.join(probe, ["part", "key"]).where(near & (F.col("fp") != F.col("other"))).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if dense is None:
        return pairs
    if tau != 2:
        raise ValueError("midpoints serve tau = 2; set dense=None for other thresholds")
    crowded = sizes.where(F.col("n") > dense).drop("n")
    crowd = index.join(crowded, ["part", "key"]).select("fp").unionByName(probe.join(crowded, ["part", "key"]).select(F.col("other").alias("fp"))).distinct()
    around = F.array(*[F.lit(_signed(w)) for w in _flips(list(range(BITS)), 1)])
    middle = crowd.select("fp", F.explode(F.transform(around, lambda w: F.col("fp").bitwiseXOR(w))).alias("middle"))
    stars = middle.groupBy("middle").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    tied = stars.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b")
    return pairs.unionByName(tied)


def near_duplicates(
    docs: DataFrame, tau: int = TAU, parts: int = PARTS, dense: int | None = DENSE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row."""
    rows = stored(fingerprints(docs, id_column, text_column), "simhash-rows")
    words = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-words")
    links = linked_words(words, tau, parts, dense)
    # Fingerprints stand for their smallest id from here on, so that a component is named by it.
    first = words.select(F.col("fp"), F.col("first"))
    named = links.distinct().join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    reach = components(named.select(F.col("x").alias("a"), F.col("y").alias("b")))
    classes = words.join(reach.withColumnRenamed("node", "first"), "first", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(classes, "fp").select("doc_id", shown, "component_id")
