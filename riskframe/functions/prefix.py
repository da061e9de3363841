"""Distributed ordered arithmetic: running sums, ranks and exact quantiles without one big task.

An unpartitioned ``Window.orderBy`` would put every row into one task, and a window over one key
would do so for a hot key. Each function here cuts the ordered column into ranges first, takes a
window inside (key, range), and adds the total of the earlier ranges of that key. The range totals
hold one row per (key, range), however large the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import scratch_path

def settle(table: DataFrame) -> DataFrame:
    """A per-group table (cut-offs, thresholds, positions), worked out once and written to shared storage.

    Its readers do not repeat its work, and its files tell the optimizer its size in bytes: small
    ones are broadcast by the session's threshold, larger ones are joined by shuffle, where adaptive
    execution splits hot groups.
    """
    path = scratch_path(table.sparkSession, "group")
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def default_ranges(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


#: Edges found before, by session, plan, and count; at most ``_REMEMBERED`` of them.
_EDGES: dict[tuple, list[float]] = {}
_REMEMBERED = 256


def value_edges(df: DataFrame, column: str, ranges: int | None = None) -> list[float]:
    """Inner edges of about equally filled ranges: one column-pruned scan with a sketch.

    Edges only steer how work is spread; any edges give the same results. So those of an equal plan
    are used again, even where its files have changed since.
    """
    count = ranges or default_ranges(df)
    if count <= 1:
        return []
    values = df.select(F.col(column).cast("double").alias(column))
    key = (df.sparkSession.sparkContext.applicationId, values.semanticHash(), count)
    if key not in _EDGES:
        if len(_EDGES) >= _REMEMBERED:
            _EDGES.clear()
        _EDGES[key] = sorted(set(values.approxQuantile(column, [i / count for i in range(1, count)], 0.25 / count)))
    return _EDGES[key]


def with_range(df: DataFrame, column: str, edges: Sequence[float], output: str) -> DataFrame:
    """Range number of ``column``, growing with it."""
    if not edges:
        return df.withColumn(output, F.lit(0.0))
    splits = [-float("inf"), *edges, float("inf")]
    typed = df.withColumn("_edge_value", F.col(column).cast("double"))
    marked = Bucketizer(
        splits=splits, inputCol="_edge_value", outputCol=output, handleInvalid="keep"
    ).transform(typed)
    return marked.drop("_edge_value")


def time_range(time: Column, span: int) -> Column:
    """Range number of an integer time; needs no look at the data."""
    return F.floor(time / F.lit(span)).cast("bigint")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    range_column: str,
    sums: Sequence[str] = (),
    maxima: Sequence[str] = (),
    descending: bool = False,
    totals: bool = False,
) -> DataFrame:
    """Add strictly-before aggregates ``before_<c>`` per key along ``order``.

    One row per (key, order) is expected, and ``range_column`` must grow with ``order``. With
    ``totals`` the whole-key sums ``total_<c>`` are added as well.
    """
    keys = list(keys)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    per_range = df.groupBy(*keys, range_column).agg(
        *[F.sum(c).alias(f"_s_{c}") for c in sums], *[F.max(c).alias(f"_m_{c}") for c in maxima]
    )
    along = Window.partitionBy(*keys).orderBy(direction(range_column)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*keys)
    offsets = per_range.select(
        *keys,
        range_column,
        *[F.sum(f"_s_{c}").over(along).alias(f"_os_{c}") for c in sums],
        *[F.max(f"_m_{c}").over(along).alias(f"_om_{c}") for c in maxima],
        *([F.sum(f"_s_{c}").over(whole).alias(f"total_{c}") for c in sums] if totals else []),
    )
    inside = Window.partitionBy(*keys, range_column).orderBy(direction(order)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = df.withColumns(
        {
            **{f"_ls_{c}": F.sum(c).over(inside) for c in sums},
            **{f"_lm_{c}": F.max(c).over(inside) for c in maxima},
        }
    )
    joined = local.join(offsets, [*keys, range_column])
    zero = F.lit(0)
    added = {
        **{f"before_{c}": F.coalesce(F.col(f"_ls_{c}"), zero) + F.coalesce(F.col(f"_os_{c}"), zero) for c in sums},
        **{f"before_{c}": F.greatest(F.col(f"_lm_{c}"), F.col(f"_om_{c}")) for c in maxima},
    }
    helper = [f"_{p}s_{c}" for p in "lo" for c in sums] + [f"_{p}m_{c}" for p in "lo" for c in maxima]
    return joined.withColumns(added).drop(*helper)


def ordered_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    probabilities: Sequence[float],
    ranges: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per key: rows (keys, probability, value).

    ``percentile`` keeps every distinct value of a group in one task; here value counts are
    summed first and the two order statistics around each probability are read off the running
    counts, so a group may be larger than any executor. ``weight`` names a column of row counts
    where ``df`` is summed already.
    """
    keys = list(keys)
    times = F.col(weight) if weight else F.lit(1).cast("bigint")
    source = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("_v"), times.alias("_t"))
    edges = value_edges(source, "_v", ranges)
    counts = source.groupBy(*keys, "_v").agg(F.sum("_t").alias("_n"))
    ranged = with_range(counts, "_v", edges, "_range")
    curve = running(ranged, keys, "_v", "_range", sums=["_n"], totals=True)
    asked = curve.withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    position = F.col("probability") * (F.col("total__n") - 1)
    low, high = F.floor(position), F.ceil(position)
    holds = lambda at: (at >= F.col("before__n")) & (at < F.col("before__n") + F.col("_n"))
    kept = asked.withColumns({"_pos": position, "_lo": low, "_hi": high}).where(
        holds(F.col("_lo")) | holds(F.col("_hi"))
    )
    found = kept.groupBy(*keys, "probability").agg(
        F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.max(F.col("_pos") - F.col("_lo")).alias("_f")
    )
    return found.select(
        *keys, "probability", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("value")
    )


def quantile_columns(
    df: DataFrame, keys: Sequence[str], column: str, named: dict[str, float], ranges: int | None = None, weight: str | None = None
) -> DataFrame:
    """``ordered_quantiles`` laid out as one row per key with a column per name."""
    long = ordered_quantiles(df, keys, column, sorted(set(named.values())), ranges, weight)
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("probability") == float(p), F.col("value"))).alias(n) for n, p in named.items()]
    )


def rank_rows(
    df: DataFrame, keys: Sequence[str], score: str, tie: str, tie_range: str, output: str = "score_rank"
) -> DataFrame:
    """Rank 1..N by score descending, then ``tie`` ascending, per key.

    ``tie_range`` must grow with ``tie``; rows are ranked inside (key, score, tie_range), so a
    score shared by a third of all rows is still split over many tasks.
    """
    keys = list(keys)
    cells = df.groupBy(*keys, score, tie_range).agg(F.count("*").alias("_c"))
    levels = cells.groupBy(*keys, score).agg(F.sum("_c").alias("_n"))
    edges = value_edges(df, score)
    curve = running(with_range(levels, score, edges, "_range"), keys, score, "_range", ["_n"], descending=True)
    inside = Window.partitionBy(*keys, score).orderBy(tie_range).rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("_before_cell", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(
        curve.select(*keys, score, "before__n"), [*keys, score]
    )
    offsets = placed.select(
        *keys, score, tie_range, (F.col("before__n") + F.col("_before_cell")).alias("_offset")
    )
    order = Window.partitionBy(*keys, score, tie_range).orderBy(tie)
    return (
        df.withColumn("_local", F.row_number().over(order))
        .join(offsets, [*keys, score, tie_range])
        .withColumn(output, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_local", "_offset")
    )


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], order_range: str, output: str = "tie_rank") -> DataFrame:
    """Rank 1..N along ``order`` per key, worked inside (key, order_range) groups."""
    keys = list(keys)
    cells = df.groupBy(*keys, order_range).agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy(order_range).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(*keys, order_range, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, order_range).orderBy(*order)
    return (
        df.withColumn("_local", F.row_number().over(inside))
        .join(offsets, [*keys, order_range])
        .withColumn(output, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_local", "_offset")
    )


def hash_range(digest: Column) -> Column:
    """Range number of a hex digest: its first three digits, so 4096 even ranges."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")
