"""Bootstrap replicates as vectors: many draws in one row.

The multiplicities of ``WIDTH`` replicates at one time group are one array. Counts by (score level, time
group) are shuffled as they are; a group of them is handed the arrays of its draws once (times x replicates
small integers), and one matrix product per chunk of replicates gives the weighted counts of all of them.

A replicate's AP needs the counts above each level, its review budget the level it ends in. Both come in
two passes: totals by score range, running totals over the ranges, then the levels inside each range.
Rows tied at a budget's last level are taken in id order, again by ranges of ids: counts decide every range
but the one in which the budget ends, and only that one is walked row by row. Past the first count by
(level, time) the work follows levels, times and replicates, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.prefix import settle, value_edges, with_range

#: Replicates in one vector.
WIDTH = 128
#: (level, time) counts of one key that a score range should hold at most.
RANGE_ROWS = 20_000


def replicate_vectors(mult: DataFrame, draw_keys: Sequence[str], width: int | None = None) -> DataFrame:
    """Multiplicities as (draw_keys, block_length, chunk, pos, m): m[i] belongs to replicate chunk * width + i + 1."""
    width = width or WIDTH
    at = F.col("replicate_id") - 1
    cells = mult.withColumns({"chunk": F.floor(at / F.lit(width)).cast("int"), "_i": F.pmod(at, F.lit(width)).cast("int")})
    held = cells.groupBy(*draw_keys, "block_length", "chunk", "pos").agg(F.map_from_entries(F.collect_list(F.struct("_i", "mult"))).alias("_m"))
    return settle(held.select(*draw_keys, "block_length", "chunk", "pos", _dense("_m", width).alias("m")))


def _dense(column: str, width: int):
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at(F.col(column), i), F.lit(0)))


def _stack(arrays: pd.Series) -> np.ndarray:
    return np.stack(arrays.to_numpy()).astype(np.int64)


def _kinds(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _weights(held: pd.DataFrame) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Drawn times in order, and per chunk the multiplicities as (time, replicate)."""
    times, at = np.unique(held["pos"].to_numpy(np.int64), return_inverse=True)
    chunk, m = held["chunk"].to_numpy(np.int64), _stack(held["m"])
    out = {}
    for c in np.unique(chunk):
        out[int(c)] = np.zeros((len(times), m.shape[1]))
        out[int(c)][at[chunk == c]] = m[chunk == c]
    return times, out


def _drawn(part: pd.DataFrame, times: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows whose time some replicate draws, and its place among the drawn times."""
    part = part[np.isin(part["pos"].to_numpy(np.int64), times)]
    return part, np.searchsorted(times, part["pos"].to_numpy(np.int64))


def _product(group: np.ndarray, place: np.ndarray, values: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sums of values[i] * m[place[i]] by group: numbers 0, 1, ... in ascending order. Exact below 2^53."""
    groups, times = int(group[-1]) + 1, len(m)
    if groups * times <= 32 * len(group):
        held = np.bincount(group * times + place, weights=values, minlength=groups * times).reshape(groups, times)
        return (held @ m).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.add.reduceat(m[place] * values[:, None], starts, axis=0).astype(np.int64)


def _grouped(part: pd.DataFrame, column: str, descending: bool) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows in order of a column, the column's values in that order, and each row's place among them."""
    part = part.sort_values(column, ascending=not descending, kind="stable")
    values = part[column].to_numpy()
    first = np.r_[True, values[1:] != values[:-1]]
    return part, values[first], np.cumsum(first) - 1


def _budgets(coarse: DataFrame, held: DataFrame, group: Sequence[str], q: float | str) -> DataFrame:
    """Per range what lies above it, and every replicate's totals and budget: (group, chunk, _range, arrays)."""
    share, group = Fraction(str(q)), list(group)

    def place(part: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        if part.empty or weights.empty:
            return pd.DataFrame()
        times, chunks = _weights(weights)
        part, at = _drawn(_grouped(part, "_range", True)[0], times)
        if part.empty:
            return pd.DataFrame()
        _, ranges, number = _grouped(part, "_range", True)
        out = []
        for chunk, m in chunks.items():
            n, p = (_product(number, at, part[c].to_numpy(float), m) for c in ("n", "p"))
            rows = n.sum(axis=0)
            whole = {"rows": rows, "positives": p.sum(axis=0), "alerts": -(-rows * share.numerator // share.denominator)}
            above_n, above_p = n.cumsum(axis=0) - n, p.cumsum(axis=0) - p
            out += [{"chunk": chunk, "_range": r, "before_n": above_n[i], "before_p": above_p[i], **whole} for i, r in enumerate(ranges)]
        return pd.DataFrame(out).assign(**{g: part[g].iloc[0] for g in group})

    arrays = ", ".join(f"{c} array<bigint>" for c in ("before_n", "before_p", "rows", "positives", "alerts"))
    schema = f"{_kinds(coarse, group)}, chunk int, {_kinds(coarse, ['_range'])}, {arrays}"
    return coarse.groupBy(*group).cogroup(held.groupBy(*group)).applyInPandas(place, schema)


def _ends(level: np.ndarray, n: np.ndarray, p: np.ndarray, above: pd.Series) -> dict[str, np.ndarray]:
    """AP share of one range, and for budgets that end in it the level, what lies above, and the room left."""
    totals = {c: np.asarray(above[c]) for c in ("before_n", "before_p", "rows", "positives", "alerts")}
    alerts, tp = totals["before_n"] + n.cumsum(axis=0), totals["before_p"] + p.cumsum(axis=0)
    gain = np.where(p > 0, p / np.maximum(totals["positives"], 1) * (tp / np.maximum(alerts, 1)), 0.0)
    ends = (totals["before_n"] < totals["alerts"]) & (totals["alerts"] <= alerts[-1])
    at, column = (alerts >= totals["alerts"]).argmax(axis=0), np.arange(n.shape[1])
    return {
        "ap": gain.sum(axis=0),
        "ends": ends,
        "level": level[at],
        "n_at": n[at, column],
        "p_at": p[at, column],
        "above": (tp - p)[at, column],
        "room": totals["alerts"] - (alerts - n)[at, column],
        **{c: totals[c] for c in ("rows", "positives", "alerts")},
    }


def _levels(part: pd.DataFrame, other: pd.DataFrame, group: Sequence[str]) -> pd.DataFrame:
    """One row per chunk for one range: ``other`` holds the multiplicities and, in rows without a time, the budgets."""
    known = other["pos"].notna()
    if part.empty or not known.any():
        return pd.DataFrame()
    times, chunks = _weights(other[known])
    part, at = _drawn(_grouped(part, "_level", True)[0], times)
    if part.empty:
        return pd.DataFrame()
    _, level, number = _grouped(part, "_level", True)
    out = []
    for _, above in other[~known].iterrows():
        n, p = (_product(number, at, part[c].to_numpy(float), chunks[above["chunk"]]) for c in ("_n", "_p"))
        out.append({**{g: part[g].iloc[0] for g in group}, "chunk": above["chunk"], **_ends(level, n, p, above)})
    return pd.DataFrame(out)


_FOUND = (
    "ap array<double>, ends array<boolean>, level array<double>, n_at array<bigint>, p_at array<bigint>, above array<bigint>, room array<bigint>,"
    " rows array<bigint>, positives array<bigint>, alerts array<bigint>"
)


def _by_replicate(df: DataFrame, keys: Sequence[str], columns: Sequence[str], width: int) -> DataFrame:
    """Arrays as one row per replicate."""
    spread = df.select(*keys, "block_length", "chunk", F.posexplode(F.arrays_zip(*columns)).alias("_i", "_v"))
    return spread.select(*keys, "block_length", (F.col("chunk") * width + F.col("_i") + 1).alias("replicate_id"), "_v.*")


def _tied_positives(df: DataFrame, ended: DataFrame, vectors: DataFrame, draw_keys, keys, score, label, identity, width: int) -> DataFrame:
    """Positives among the rows of a budget's last level that still fit, in id order: (keys, block_length, replicate_id, part)."""
    group, every = [*keys, "block_length"], [*keys, "block_length", "replicate_id"]
    split = ended.where(F.col("room") < F.col("n_at")).select(*every, F.col("level").alias("_level"), "room")
    level = F.col(score).cast("double").alias("_level")
    members = df.select(*keys, "pos", level, F.col(label).cast("bigint").alias("_y"), F.col(identity).alias("_id"))
    members = with_range(members.join(split.select(*keys, "_level").distinct(), [*keys, "_level"], "left_semi"), "_id", value_edges(df, identity), "_ids")
    counts = members.groupBy(*keys, "_level", "_ids", "pos").agg(F.count("*").alias("n"), F.sum("_y").alias("p"))
    counts = counts.join(split.select(*group, "_level").distinct(), [*keys, "_level"])
    held = vectors.join(split.select(*group).distinct(), [*draw_keys, "block_length"]).unionByName(split, allowMissingColumns=True)

    def cut(part: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        known = other["pos"].notna()
        if part.empty or not known.any():
            return pd.DataFrame()
        times, chunks = _weights(other[known])
        out = []
        tied = dict(list(part.groupby("_level", sort=False)))
        for at_level, asked in other[~known].groupby("_level", sort=False):
            rows, at = _drawn(_grouped(tied[at_level], "_ids", False)[0], times)
            _, ranges, number = _grouped(rows, "_ids", False)
            replicate = asked["replicate_id"].to_numpy(np.int64) - 1
            m = np.column_stack([chunks[r // width][:, r % width] for r in replicate])
            n, p = (_product(number, at, rows[c].to_numpy(float), m) for c in ("n", "p"))
            left = asked["room"].to_numpy(np.int64) - (n.cumsum(axis=0) - n)
            whole, last = np.where(left >= n, p, 0).sum(axis=0), (left > 0) & (left < n)
            at_range, column = last.argmax(axis=0), np.arange(len(replicate))
            out.append(pd.DataFrame({
                "replicate_id": replicate + 1, "_level": at_level, "part": whole, "ends": last.any(axis=0), "_ids": ranges[at_range], "left": left[at_range, column],
                "times": [times] * len(replicate), "weights": list(m.T.astype(np.int64)),
            }))
        return pd.concat(out).assign(**{g: part[g].iloc[0] for g in group})

    schema = f"{_kinds(ended, every)}, _level double, part bigint, ends boolean, {_kinds(members, ['_ids'])}, left bigint, times array<bigint>, weights array<bigint>"
    cuts = settle(counts.groupBy(*group).cogroup(held.groupBy(*group)).applyInPandas(cut, schema))
    cell = [*keys, "_level", "_ids"]
    open_ = cuts.where("ends").select(*every, "_level", "_ids", "left", "times", "weights")

    def take(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if part.empty or asked.empty:
            return pd.DataFrame()
        part = part.sort_values("_id", kind="stable")
        pos, y = part["pos"].to_numpy(np.int64), part["_y"].to_numpy(np.int64)
        taken = []
        for left, times, weights in zip(asked["left"], asked["times"], asked["weights"]):
            at = np.minimum(np.searchsorted(times, pos), len(times) - 1)
            m = np.where(times[at] == pos, weights[at], 0)
            taken.append(int(y @ np.clip(left - (m.cumsum() - m), 0, m)))
        return asked[every].assign(part=taken)

    walked = members.join(open_.select(*cell).distinct(), cell, "left_semi")
    parts = walked.groupBy(*cell).cogroup(open_.groupBy(*cell)).applyInPandas(take, f"{_kinds(cuts, every)}, part bigint")
    return cuts.select(*every, "part").unionByName(parts).groupBy(*every).agg(F.sum("part").alias("part"))


def _sums(label: str) -> list:
    return [F.count("*").alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_p")]


def level_counts(df: DataFrame, keys: Sequence[str], scores: Sequence[str], label: str) -> DataFrame:
    """(keys, pos, scores, _n, _p): rows and positives by time and score level, written once; what follows on levels needs no rows."""
    return settle(df.groupBy(*keys, "pos", *scores).agg(*_sums(label)))


def vector_replicates(
    df: DataFrame,
    mult: DataFrame,
    draw_keys: Sequence[str],
    keys: Sequence[str],
    score: str,
    label: str,
    identity: str | None = None,
    q: float | str = 0.03,
    width: int | None = None,
    counted: bool = False,
) -> DataFrame:
    """n, positives, alerts, tp and ap of every replicate and key: as ``bootstrap.replicate_table``, for any number of draws.

    Without ``identity`` budgets are left out: n, positives and ap. Then ``df`` may be ``counted``: rows of ``level_counts``.
    Replicates without positives have a null AP; those without rows are absent.
    """
    keys, draw_keys, width = list(keys), list(draw_keys), width or WIDTH
    group, every = [*keys, "block_length"], [*keys, "block_length", "replicate_id"]
    vectors = replicate_vectors(mult, draw_keys, width)
    if counted and identity is not None:
        raise ValueError("counts have no identity")
    level = F.col(score).cast("double").alias("_level")
    sums = [F.sum("_n").alias("_n"), F.sum("_p").alias("_p")] if counted else _sums(label)
    counts = settle(df.groupBy(*keys, "pos", level).agg(*sums))
    most = counts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    cells = with_range(counts, "_level", value_edges(counts, "_level", max(1, -(-most // RANGE_ROWS))), "_range")
    blocks = settle(vectors.select(*draw_keys, "block_length").distinct())
    coarse = cells.groupBy(*keys, "pos", "_range").agg(F.sum("_n").alias("n"), F.sum("_p").alias("p"))
    places = settle(coarse.select(*keys, "_range").distinct())
    handed = vectors.join(places.select(*keys).distinct(), draw_keys)
    budgets = settle(_budgets(coarse.join(blocks, draw_keys), handed, group, q))
    inside = [*group, "_range"]
    ranged = cells.join(blocks, draw_keys)
    other = vectors.join(places, draw_keys).unionByName(budgets, allowMissingColumns=True)
    kernel = lambda part, other: _levels(part, other, inside)
    found = ranged.groupBy(*inside).cogroup(other.groupBy(*inside)).applyInPandas(kernel, f"{_kinds(ranged, inside)}, chunk int, {_FOUND}")
    columns = ["ap", "ends", "level", "n_at", "p_at", "above", "room", "rows", "positives", "alerts"]
    here = lambda c: F.max(F.when(F.col("ends"), F.col(c))).alias(c)
    ended = _by_replicate(found, keys, columns, width).where(F.col("rows") > 0).groupBy(*every).agg(
        F.when(F.max("positives") > 0, F.sum("ap")).alias("ap"),
        *[F.max(c).alias(c) for c in ("rows", "positives", "alerts")],
        *[here(c) for c in ("level", "n_at", "p_at", "above", "room")],
    )
    if identity is None:
        return ended.select(*every, F.col("rows").alias("n"), "positives", "ap")
    ended = settle(ended)
    tied = _tied_positives(df, ended, vectors, draw_keys, keys, score, label, identity, width)
    last = F.when(F.col("room") == F.col("n_at"), F.col("p_at")).otherwise(F.coalesce("part", F.lit(0)))
    return ended.join(tied, every, "left").select(*every, F.col("rows").alias("n"), "positives", "alerts", (F.col("above") + last).alias("tp"), "ap")
