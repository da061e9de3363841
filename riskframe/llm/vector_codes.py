"""Product codes of vectors, trained with norm-of-sum bounds.

Vectors are cut into equal parts; every part position has its own codebook. Training assigns each
part to its nearest entry and replaces entries by their parts' means, a fixed number of rounds. Exact
distances are mostly avoided: a part keeps its entry, an upper bound on the distance to it and a lower
bound on the distance to all others, each stamped with the round it was measured in. All codebooks
of the past are retained (a few kilobytes a round), so the triangle inequality is applied once with the
true net displacement of an entry since the stamp, the norm of the sum of its moves, instead of the
sum of the moves' norms. If upper plus displacement stays below lower minus the others' largest
displacement, the entry stands; else the distance to the own entry is measured and the test repeated;
only then are all entries scanned again. Bounds are kept as 32-bit floats rounded outward, codes
and codebooks come from integers alone, so results are exact.

The state of a round is a written table of blocks (vectors, entries, bounds, stamps, and sums by part
and entry), read by the next round and removed after it; the sums of all blocks meet in one small
aggregation. Only codebooks reach the driver.

Start: the k rows with the smallest ids (rows without id last, equal ids by components); with fewer rows
there are as many entries. Ties in distance go to the lower index; means are rounded down; an unused
entry stays. Null vectors and those with null or non-finite components take no part. Vectors shorter
than the longest, or than a multiple of the parts, end in zeros. Null and repeated ids are rows like
others, null labels are one label. Distances that 64 bits cannot hold raise an error. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import discard, stored
from riskframe.llm.vectors import finite, fits, integers, largest, listed, matrix, slices

_STATE = ["v", "entry", "upper", "lower", "upper_round", "lower_round", "sums"]


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def displacements(history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From every past round to the last: net move of each entry, and the largest of the others. Shape (rounds, parts, k)."""
    net = np.sqrt(((history[-1:] - history) ** 2).sum(axis=3).astype(np.float64)) * (1 + 1e-12)
    if net.shape[2] == 1:
        return net, np.zeros_like(net)
    order = np.sort(net, axis=2)
    first, second = order[..., -1:], order[..., -2:-1]
    lead = np.arange(net.shape[2]) == net.argmax(axis=2)[..., None]
    return net, np.where(lead, second, first)


class Part:
    """Assignment of one part of a block of vectors."""

    def __init__(self, vectors: np.ndarray):
        n = len(vectors)
        self.vectors = vectors
        self.entry = np.zeros(n, np.uint8)
        self.upper, self.lower = np.full(n, np.inf, np.float32), np.full(n, -np.inf, np.float32)
        self.upper_round, self.lower_round = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        self.scans = 0

    def own_distance(self, entries: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return ((self.vectors[rows] - entries[self.entry[rows]]) ** 2).sum(axis=1)

    def step(self, entries: np.ndarray, net: np.ndarray, others: np.ndarray) -> None:
        """Nearest entries by the last of the codebooks whose displacements are ``net`` and ``others``."""
        now = len(net) - 1
        lower = self.lower - others[self.lower_round, self.entry]
        open_ = np.flatnonzero(~(self.upper + net[self.upper_round, self.entry] < lower * (1 - 1e-9)))
        own = np.sqrt(self.own_distance(entries, open_).astype(np.float64)) * (1 + 1e-12)
        self.upper[open_], self.upper_round[open_] = _up(own), now
        scan = open_[~(self.upper[open_] < lower[open_] * (1 - 1e-9))]
        distance = np.zeros((len(scan), len(entries)), np.int64)
        for d, values in enumerate(self.vectors[scan].T):
            distance += (values[:, None] - entries[:, d]) ** 2
        best = distance.argmin(axis=1)
        at = np.arange(len(scan))
        self.entry[scan] = best
        self.upper[scan] = _up(np.sqrt(distance[at, best].astype(np.float64)) * (1 + 1e-12))
        distance[at, best] = np.iinfo(np.int64).max
        self.lower[scan] = _down(np.sqrt(distance.min(axis=1).astype(np.float64)) * (1 - 1e-12)) if len(scan) else 0
        self.upper_round[scan] = self.lower_round[scan] = now
        self.scans += len(scan)

    def sums(self, k: int) -> np.ndarray:
        """Count and component sums by entry. Doubles hold a block's sums exactly."""
        n = np.bincount(self.entry, minlength=k)
        return np.column_stack([n, *(np.bincount(self.entry, weights=c, minlength=k) for c in self.vectors.T)]).astype(np.int64)


class Block:
    """Parts of the vectors of one row of the state table."""

    def __init__(self, vectors: np.ndarray, parts: int):
        self.parts = [Part(p) for p in np.split(vectors, parts, axis=1)]

    @classmethod
    def read(cls, held: dict[str, bytes], n: int, parts: int) -> Block:
        block = cls(np.frombuffer(held["v"], np.int64).reshape(n, -1), parts)
        for name, kind in (("entry", np.uint8), ("upper", np.float32), ("lower", np.float32), ("upper_round", np.uint8), ("lower_round", np.uint8)):
            for part, values in zip(block.parts, np.frombuffer(held[name], kind).reshape(parts, n).copy()):
                setattr(part, name, values)
        return block

    def step(self, history: np.ndarray) -> None:
        net, others = displacements(history)
        for p, part in enumerate(self.parts):
            part.step(history[-1, p], net[:, p], others[:, p])

    def state(self, k: int) -> list[pa.Array]:
        held = {name: b"".join(getattr(p, name).tobytes() for p in self.parts) for name in _STATE[1:-1]}
        held["v"] = np.hstack([p.vectors for p in self.parts]).tobytes()
        held["sums"] = np.stack([p.sums(k) for p in self.parts]).tobytes()
        return [*(pa.array([held[name]], pa.binary()) for name in _STATE), pa.array([sum(p.scans for p in self.parts)], pa.int64())]


def _blocks(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for row in range(batch.num_rows):
        one = batch.slice(row, 1)
        held = {name: one.column(name)[0].as_py() for name in _STATE[:-1]}
        yield one, Block.read(held, len(one.column("vec_id")[0].values), parts)


def stepper(history: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One round over state blocks: new entries, bounds and sums under the last codebooks of ``history``."""
    parts, k = history.shape[1:3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, block in _blocks(batch, parts):
                block.step(history)
                yield pa.RecordBatch.from_arrays([one.column("vec_id"), one.column("label"), *block.state(k)], ["vec_id", "label", *_STATE, "scans"])

    return run


def moved(state: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks after a round: exact means of the parts of each entry, rounded down."""
    parts, k, width = codebooks.shape
    cells = parts * k * (width + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for sums in batch.column("sums").to_pylist():
                total += np.frombuffer(sums, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": at, "total": total[at]})

    rows = state.select("sums").mapInArrow(add, "cell long, total long")
    exact = {r[0]: int(r[1]) for r in rows.groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect()}
    out = codebooks.copy()
    for p in range(parts):
        for e in range(k):
            at = (p * k + e) * (width + 1)
            if exact.get(at):
                out[p, e] = [exact.get(at + 1 + d, 0) // exact[at] for d in range(width)]
    return out


def compress_vectors(
    vectors: DataFrame,
    parts: int = 8,
    k: int = 16,
    rounds: int = 6,
    scale: float = 4096.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every vector that takes part (k up to 256)."""
    spark, x = vectors.sparkSession, F.col(vector_column)
    rows = vectors.where(finite(x)).select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"), integers(x, scale).alias("v"))
    kind = rows.schema["label"].dataType.simpleString()
    longest, reach = largest(rows)
    width = -(-longest // parts) * parts
    fits(width, reach)
    seeds = [r["v"] for r in rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(k).collect()]
    if not seeds:
        empty = f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string"
        return spark.createDataFrame([], empty)
    start = np.array([[*v, *[0] * (width - len(v))] for v in seeds], np.int64)
    history = np.stack(np.split(start, parts, axis=1))[None]  # (rounds, parts, entries, components)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, width):
            block = Block(matrix(batch.column("v"), width), parts)
            block.step(history)
            arrays = [listed(batch.column("vec_id")), listed(batch.column("label")), *block.state(history.shape[2])]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "label", *_STATE, "scans"])

    schema = f"vec_id array<bigint>, label array<{kind}>, " + ", ".join(f"{c} binary" for c in _STATE) + ", scans long"
    state = stored(rows.mapInArrow(pack, schema), "codes-state")
    for at in range(rounds):
        history = np.concatenate([history, moved(state, history[-1])[None]])
        if at < rounds - 1:
            before, state = state, stored(state.mapInArrow(stepper(history), schema), "codes-state")
            discard(before)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, block in _blocks(batch, parts):
                block.step(history)
                error = sum(part.own_distance(entries) for part, entries in zip(block.parts, history[-1]))
                digits = np.column_stack([part.entry for part in block.parts]).tobytes().hex()
                text = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([one.column("vec_id")[0].values, one.column("label")[0].values, pa.array(text), pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = stored(state.mapInArrow(codes, f"vec_id long, label {kind}, code string, error long"), "codes-rows")
    discard(state)
    total = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    by_label = stored(total.withColumnRenamed("label", "_label"), "codes-labels")
    digest = hashlib.sha256(",".join(map(str, history[-1].ravel().tolist())).encode("ascii")).hexdigest()
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
