"""Integer vectors in blocks, shared by the operators on embeddings.

Components become ``floor(scale * x)``, so all later arithmetic is exact. Rows are packed, one block
per Arrow batch, into numpy matrices; a block holds at most ``CELLS`` components, so a task's memory
does not depend on the table. Ids and labels ride along as Arrow lists and may be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of one block at most.
CELLS = 1 << 19


def finite(vector: Column) -> Column:
    """Whether a vector is there and none of its components is null, NaN or infinite."""
    return vector.isNotNull() & ~F.exists(vector, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))


def integers(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of ``width`` columns; shorter ones end in zeros."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of at most ``CELLS`` components."""
    step = max(1, CELLS // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def listed(column: pa.Array) -> pa.Array:
    """A whole column as the only element of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.LargeListArray.from_arrays([0, len(column)], column).cast(pa.list_(column.type))


def largest(rows: DataFrame, column: str = "v") -> tuple[int, int]:
    """Longest vector and largest absolute component of the integer vectors of ``column`` (0, 0 without rows)."""
    reach = F.array_max(F.transform(column, lambda e: F.abs(e)))
    found = rows.agg(F.max(F.size(column)), F.max(reach)).first()
    return found[0] or 0, found[1] or 0


def fits(width: int, reach: int) -> None:
    """Error where a squared distance of two such vectors may exceed 64 bits."""
    if width * (2 * reach) ** 2 >= 1 << 62:
        raise ValueError("a squared distance may exceed 64 bits")
