"""Centroid clustering (k-means on integers) by scalar lookup tables.

Vectors of exactly ``width`` components become integers. A block of them keeps, per dimension, the
integer values that occur in it and one place into those values per vector. A round tabulates
(value - centroid) squared once for every dimension, occurring value and centroid; the distances of
a vector to all centroids are then one gather and one sum per dimension, whatever the number of
vectors behind a value. Assignments are not kept between rounds: a round is one pass over the written
blocks, which sends (cluster, dimension, sum, count) of each task to one small aggregation.

Start: the k vectors with the smallest SHA-256 of ``salt:id``, rows without id last, equal hashes by
components. Ties in distance go to the smaller number; sums and counts are exact, means rounded down;
an empty centroid stays. With fewer than k vectors there are as many centroids as vectors.

Vectors of another length, null, or with null or non-finite components take no part. Null and
repeated ids are rows like others. Distances that 64 bits cannot hold raise an error. An empty table
gives an empty result. Columns other than id and vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import stored
from riskframe.llm.vectors import finite, fits, integers, largest, listed, matrix, slices

BLOCKS = "vec_id array<bigint>, occurring binary, starts binary, places binary"


def tabulated_block(ids: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
    """One block: occurring values of all dimensions in a row, where each dimension starts, and the place of every component."""
    occurring, starts, places = [], [0], np.empty(vectors.T.shape, np.int32)
    for d, column in enumerate(vectors.T):
        values, place = np.unique(column, return_inverse=True)
        places[d] = place + starts[-1]
        occurring.append(values)
        starts.append(starts[-1] + len(values))
    joined = np.concatenate(occurring) if occurring else np.empty(0, np.int64)
    columns = [listed(ids), *(pa.array([a.tobytes()], pa.binary()) for a in (joined, np.array(starts, np.int32), places))]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "occurring", "starts", "places"])


class Block:
    def __init__(self, batch: pa.RecordBatch, row: int, width: int):
        held = {name: batch.column(name)[row] for name in batch.schema.names}
        self.ids = held["vec_id"].values
        self.occurring = np.frombuffer(held["occurring"].as_py(), np.int64)
        self.dimension = np.repeat(np.arange(width), np.diff(np.frombuffer(held["starts"].as_py(), np.int32)))
        self.places = np.frombuffer(held["places"].as_py(), np.int32).reshape(width, len(self.ids))

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of every vector and its squared distance, by table gathers."""
        table = (self.occurring[:, None] - centroids.T[self.dimension]) ** 2
        distance = np.zeros((self.places.shape[1], len(centroids)), np.int64)
        for places in self.places:
            distance += table[places]
        cluster = distance.argmin(axis=1)
        return cluster, distance[np.arange(len(cluster)), cluster]

    def vectors(self) -> np.ndarray:
        """Components, one row per dimension."""
        return self.occurring[self.places]


def cluster_sums(blocks: DataFrame, centroids: np.ndarray) -> list:
    """Rows (cluster, dimension, total, n) over all vectors; dimension -1 carries the count alone."""
    k, width = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row, width)
                cluster, _ = block.nearest(centroids)
                n += np.bincount(cluster, minlength=k)
                for d, values in enumerate(block.vectors()):
                    # Sums of a block stay far below 2^53, so doubles hold them exactly.
                    total[:, d] += np.bincount(cluster, weights=values, minlength=k).astype(np.int64)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": np.repeat(used, width + 1).astype(np.int32),
                "dimension": np.tile(np.arange(-1, width), len(used)).astype(np.int32),
                "total": np.column_stack([n[used], total[used]]).ravel(),
            }
        )

    sums = blocks.mapInArrow(add, "cluster int, dimension int, total long")
    return sums.groupBy("cluster", "dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()


def moved(centroids: np.ndarray, sums: list) -> np.ndarray:
    """Centroids after a round: means rounded down; those without vectors stay."""
    exact = {(r["cluster"], r["dimension"]): int(r["total"]) for r in sums}
    out = centroids.copy()
    for (c, d), total in exact.items():
        if d >= 0:
            out[c, d] = total // exact[c, -1]
    return out


def cluster_vectors(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    scale: float = 64.0,
    width: int = 64,
    salt: str = "1",
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    x = F.col(vector_column)
    rows = vectors.where(finite(x) & (F.size(x) == width)).select(F.col(id_column).cast("long").alias("vec_id"), integers(x, scale).alias("v"))
    fits(width, largest(rows)[1])
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    seeds = rows.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    if not seeds:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    centroids = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, width):
            yield tabulated_block(batch.column("vec_id"), matrix(batch.column("v"), width))

    blocks = stored(rows.mapInArrow(pack, BLOCKS), "centroids-blocks")
    for _ in range(rounds):
        centroids = moved(centroids, cluster_sums(blocks, centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row, width)
                cluster, distance = block.nearest(centroids)
                yield pa.RecordBatch.from_arrays([block.ids, pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = stored(blocks.mapInArrow(assign, "vec_id long, cluster int, distance long"), "centroids-rows")
    per_cluster = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    inertia = [int(per_cluster.get(c, 0)) for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode("ascii")).hexdigest() for c in centroids]
    at = F.col("cluster") + 1
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        F.element_at(F.array(*[F.lit(i).cast("long") for i in inertia]), at).alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"),
        F.element_at(F.array(*map(F.lit, digests)), at).alias("centroid_sha256"),
    )
