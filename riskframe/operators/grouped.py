"""Logistic models of every grid cell at once.

A cell is a fold, a scheme of columns and class weights, or any other key. All of them are fitted
together: rows are packed into blocks of one cell and written once; a Newton step is one pass over the blocks, where
each task sums gradient and curvature of every cell that it meets, one small grouped sum over the tasks, and one
solve a cell, a row each. The driver sees only whether some cell still moves, so the number of cells costs rows, not jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.features import leakage_guard
from riskframe.functions.prefix import settle
from riskframe.functions.scalars import expit


def scheme_rows(df: DataFrame, schemes: dict[str, dict], label: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row and scheme: ``keep``, model, x (its columns, zeros to the widest), y and w.

    A scheme names its ``numeric`` columns and, if it is not 1, the ``positive_weight`` of the positives.
    """
    width = max(len(s["numeric"]) for s in schemes.values())
    entries = []
    for name, s in schemes.items():
        leakage_guard(list(s["numeric"]), df.columns)
        x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in s["numeric"]]
        weight = F.when(F.col(label) == 1, F.lit(float(s.get("positive_weight", 1.0)))).otherwise(F.lit(1.0))
        entries.append(F.struct(F.lit(name).alias("model"), F.array(*x, *[F.lit(0.0)] * (width - len(x))).alias("x"), weight.alias("w")))
    long = df.withColumn("_s", F.explode(F.array(*entries)))
    return long.select(*keep, "_s.model", "_s.x", F.col(label).cast("double").alias("y"), "_s.w")


def _blocks(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of each Arrow batch packed by cell: (keys, x, y, w), with x row by row in one array. Written once, read by every step."""
    keys = list(keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(number, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(number[order]) > 0])
            ends = np.r_[first, len(order)]
            held = batch.take(pa.array(order))
            lengths = np.r_[0, np.cumsum(held["x"].value_lengths().to_numpy(zero_copy_only=False))]
            listed = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
            columns = [*held.select(keys).take(pa.array(first)).columns, listed(lengths[ends], held["x"].flatten())]
            yield pa.RecordBatch.from_arrays([*columns, listed(ends, held["y"]), listed(ends, held["w"])], names=[*keys, "x", "y", "w"])

    return settle(rows.select(*keys, "x", "y", "w").mapInArrow(pack, f"{_kinds(rows, keys)}, x array<double>, y array<double>, w array<double>"))


def _kinds(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _cell_sums(blocks: DataFrame, keys: Sequence[str], state: Sequence[str], kernel: Callable) -> DataFrame:
    """(keys, s): the sums of ``kernel(x, y, w, block)`` over all blocks of each cell."""
    keys = list(keys)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for block in batch.to_dict("records"):
                key, y = tuple(block[k] for k in keys), block["y"]
                found = kernel(block["x"].reshape(len(y), -1), y, block["w"], block)
                total[key] = total[key] + found if key in total else found
        if total:
            yield pd.DataFrame({**{k: [key[i] for key in total] for i, k in enumerate(keys)}, "s": list(total.values())})

    parts = blocks.select(*keys, "x", "y", "w", *state).mapInPandas(add, f"{_kinds(blocks, keys)}, s array<double>")
    each = parts.select(*keys, F.posexplode("s").alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda e: e["_v"]).alias("s"))


def _scales(x: np.ndarray, y: np.ndarray, w: np.ndarray, _: dict) -> np.ndarray:
    return np.concatenate([[w.sum(), (w * w).sum()], w @ x, w @ (x * x)])


def _newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, row: dict) -> np.ndarray:
    """Loss, gradient and curvature at the cell's coefficients, on centred and scaled columns behind a column of ones."""
    z = np.column_stack([np.ones(len(x)), (x - np.asarray(row["mean"])) * np.asarray(row["inverse"])])
    margin = z @ np.asarray(row["beta"])
    loss = w @ (np.logaddexp(0.0, margin) - y * margin)
    p = 1 / (1 + np.exp(-margin))
    return np.concatenate([[loss], (w * (p - y)) @ z, ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()])


def fit_logistic_cells(rows: DataFrame, keys: Sequence[str], penalty: float = 1e-4, most: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(keys, intercept, coefficients, iterations, converged) of every cell of rows (keys, x, y, w).

    The mean weighted log loss plus ``penalty`` / 2 times the squared coefficients of the scaled columns is least;
    the intercept is free, constant columns get 0. A step that would raise the loss is halved. A cell that still
    moves after ``most`` steps is not converged and no basis for inference.
    """
    keys = list(keys)
    blocks = _blocks(rows, keys)
    sums = _cell_sums(blocks, keys, [], _scales)
    width = F.size("s") / 2 - 1
    sw, sww = F.col("s")[0], F.col("s")[1]
    mean = F.transform(F.slice("s", F.lit(3), width.cast("int")), lambda e: e / sw)
    squares = F.transform(F.slice("s", (width + 3).cast("int"), width.cast("int")), lambda e: e / sw)
    spread = F.zip_with(squares, mean, lambda a, m: F.greatest(F.lit(0.0), a - m * m) * sw / (sw - sww / sw))
    # A column whose variance is rounding noise beside its size is constant.
    inverse = F.zip_with(spread, squares, lambda v, a: F.when(v > a * 1e-13, 1 / F.sqrt(v)).otherwise(F.lit(0.0)))
    state = settle(
        sums.select(*keys, sw.alias("total"), mean.alias("mean"), inverse.alias("inverse")).select(
            "*",
            F.array_repeat(F.lit(0.0), F.size("mean") + 1).alias("beta"),
            F.array_repeat(F.lit(0.0), F.size("mean") + 1).alias("held"),
            F.lit(float("inf")).alias("loss"),
            F.lit(float("inf")).alias("step"),
            F.lit(0).alias("iterations"),
        )
    )

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                s, beta, n = np.asarray(row.pop("s")), np.asarray(row["beta"]), len(row["beta"])
                ridge = np.full(n, penalty)
                ridge[0] = 0.0
                loss = s[0] / row["total"] + (ridge * beta * beta).sum() / 2
                if loss > row["loss"] + 1e-13 * abs(row["loss"]):
                    row["beta"] = (beta + np.asarray(row["held"])) / 2
                else:
                    gradient = s[1 : n + 1] / row["total"] + ridge * beta
                    curvature = s[n + 1 :].reshape(n, n) / row["total"] + np.diag(ridge)
                    used = np.flatnonzero(np.r_[True, np.asarray(row["inverse"]) > 0])
                    move = np.zeros(n)
                    move[used] = np.linalg.lstsq(curvature[np.ix_(used, used)], gradient[used], rcond=None)[0]
                    row.update(held=beta, loss=loss, beta=beta - move, step=float(np.abs(move).max()))
                row["iterations"] += 1
                out.append(row)
            if out:
                yield pd.DataFrame(out)

    names = ["total", "mean", "inverse", "beta", "held", "loss", "step", "iterations"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields)
    for _ in range(most):
        open_ = state.where(F.col("step") > tolerance)
        found = _cell_sums(blocks.join(open_.select(*keys, "mean", "inverse", "beta"), keys), keys, ["mean", "inverse", "beta"], _newton_sums)
        stepped = open_.join(found, keys).select(*keys, *names, "s").mapInPandas(advance, schema)
        state = settle(stepped.unionByName(state.where(F.col("step") <= tolerance)))
        if not state.where(F.col("step") > tolerance).limit(1).count():
            break
    slopes = F.zip_with(F.slice("beta", F.lit(2), F.size("beta") - 1), "inverse", lambda b, i: b * i)
    fitted = state.withColumn("coefficients", slopes)
    shift = F.aggregate(F.zip_with("coefficients", "mean", lambda b, m: b * m), F.lit(0.0), lambda a, e: a + e)
    return settle(fitted.select(*keys, (F.col("beta")[0] - shift).alias("intercept"), "coefficients", "iterations", (F.col("step") <= tolerance).alias("converged")))


def score_cells(rows: DataFrame, keys: Sequence[str], fitted: DataFrame, output: str = "raw", margin: bool = False) -> DataFrame:
    """Rows (keys, x) of fitted cells with their probability, or its margin; by built-in functions."""
    total = F.aggregate(F.zip_with("x", "coefficients", lambda a, b: a * b), F.col("intercept"), lambda a, e: a + e)
    scored = rows.join(fitted.select(*keys, "intercept", "coefficients"), list(keys))
    return scored.withColumn(output, total if margin else expit(total)).drop("intercept", "coefficients")
