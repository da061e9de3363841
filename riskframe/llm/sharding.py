"""Sharding by a k-d tree over group metadata, so that shards hold about equal bytes.

Rows with equal texts form a group that stays in one shard. A group has metadata dimensions (its
smallest doc_id, its text size, its largest n_chars, its smallest source) scaled to one common range. A
node of the tree with k shards to fill is cut along its widest dimension at the weighted quantile
floor(k / 2) / k of its bytes, and so on until a node has one shard, that is the target bytes. Ties
in a dimension are ordered by a hash of the group, so equal metadata never stops a cut.

All nodes of a level are cut together. The driver holds the tree (one cut per shard) and histograms
of at most ``BINS`` sums per node; a quantile is found by narrowing the range of its bin, until the
bin holds one group or a ten-thousandth of the node. Rows get their shard from the tree as one
expression. Slots number the rows of a shard from 0: rows are dealt to buckets of a bounded size by
a hash of their id, numbered there, and moved up by the rows of the buckets before.

A group of over one shard's fair part stays whole and has a shard of its own, which is then as large
as the group; the tree cuts the rest into the other shards, and no side of a cut gets more shards than
it has groups. Null texts count as empty (8 bytes); null metadata as the smallest value.
Repeated rows count each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import stored, text_of

BINS = 1024
#: Rows of one slot bucket, about.
BUCKET = 20_000
OVERHEAD = 8
_SCALE = (1 << 30) - 1


def _choose(nodes: dict[int, dict], cuts: list[tuple[int, int, int, int, int]]) -> Column:
    """Node of a group: each cut (node, dimension, key, left, right) sends keys up to ``key`` left."""
    at = {node: (dim, key, left, right) for node, dim, key, left, right in cuts}

    def under(node: int) -> Column:
        if node not in at:
            return F.lit(node)
        dim, key, left, right = at[node]
        return F.when(F.col(f"k{dim}") <= F.lit(key), under(left)).otherwise(under(right))

    return under(0)


def _quantiles(groups: DataFrame, wanted: dict[int, tuple[int, float, int, int]]) -> dict[int, tuple[int, float, int]]:
    """Per node (dimension, bytes wanted on the left, lowest key, highest key): the cut key, the bytes and the groups up to it."""
    found: dict[int, tuple[int, float, int]] = {}
    open_ = {n: {"dim": d, "want": w, "lo": lo, "hi": hi, "before": 0.0, "passed": 0, "tol": None} for n, (d, w, lo, hi) in wanted.items()}
    while open_:
        key = lo = step = None
        for n, s in open_.items():
            width = (s["hi"] - s["lo"]) // BINS + 1
            s["step"] = width
            hit = F.col("node") == n
            inside = hit & F.col(f"k{s['dim']}").between(s["lo"], s["hi"])
            b = F.floor((F.col(f"k{s['dim']}") - F.lit(s["lo"])) / F.lit(width)).cast("int")
            key = F.when(inside, b) if key is None else key.when(inside, b)
            lo = F.when(hit, F.col(f"k{s['dim']}")) if lo is None else lo.when(hit, F.col(f"k{s['dim']}"))
        sums = (
            groups.select("node", "bytes", key.alias("bin"), lo.alias("key"))
            .where("bin IS NOT NULL")
            .groupBy("node", "bin")
            .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
            .collect()
        )
        by: dict[int, list] = {}
        for r in sums:
            by.setdefault(r["node"], []).append(r)
        for n in list(open_):
            s, before, passed = open_[n], open_[n]["before"], open_[n]["passed"]
            rows = sorted(by[n], key=lambda r: r["bin"])
            s["tol"] = s["tol"] or sum(r["bytes"] for r in rows) / 10_000
            last = s["lo"] - 1
            for r in rows:
                if before + r["bytes"] >= s["want"] or r is rows[-1]:
                    break
                before, passed, last = before + r["bytes"], passed + r["n"], r["hi"]
            if r["lo"] == r["hi"] or r["bytes"] <= s["tol"]:
                over = abs(before + r["bytes"] - s["want"]) < abs(s["want"] - before)
                found[n] = (r["hi"], before + r["bytes"], passed + r["n"]) if over or before == 0 else (last, before, passed)
                del open_[n]
            else:
                s.update(lo=r["lo"], hi=r["hi"], before=before, passed=passed)
    return found


def grow_tree(groups: DataFrame, dims: int, shards: int) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """Cuts of the tree, and the shard of each leaf. groups: k0..k(dims - 1) keys, bytes."""
    cuts: list[tuple[int, int, int, int, int]] = []
    fill, fresh = {0: shards}, 1
    while any(k > 1 for k in fill.values()):
        now = groups.withColumn("node", _choose({}, cuts))
        ranges = [f(f"k{d}").alias(f"{f.__name__}{d}") for d in range(dims) for f in (F.min, F.max)]
        stats = {r["node"]: r for r in now.groupBy("node").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), *ranges).collect()}
        wanted = {}
        for n in [n for n, k in fill.items() if k > 1]:
            r = stats.get(n)
            if r is None or r["n"] < 2:
                fill[n] = -fill[n]
                continue
            d = max(range(dims), key=lambda d: ((r[f"max{d}"] >> 32) - (r[f"min{d}"] >> 32), -d))
            wanted[n] = (d, r["bytes"] * (fill[n] // 2) / fill[n], r[f"min{d}"], r[f"max{d}"])
        if wanted:
            for n, (key, left, count) in _quantiles(now, wanted).items():
                k, share = fill.pop(n), left / stats[n]["bytes"]
                if key >= wanted[n][3]:
                    fill[n] = -k
                    continue
                kl = min(k - 1, count, max(1, k - (stats[n]["n"] - count), round(k * share)))
                cuts.append((n, wanted[n][0], key, fresh, fresh + 1))
                fill[fresh], fill[fresh + 1] = kl, k - kl
                fresh += 2
    number, leaves = 0, {}
    for n in sorted(fill):
        leaves[n] = number
        number += abs(fill[n])
    return cuts, leaves


def oversized(groups: DataFrame, shards: int) -> list[bytearray]:
    """The groups (fewer than ``shards``) that are larger than a fair part of what they and smaller groups hold."""
    rest, found = groups.agg(F.sum("bytes")).first()[0] or 0, []
    for r in groups.select("content", "bytes").orderBy(F.desc("bytes"), "content").limit(shards).collect():
        if r["bytes"] * (shards - len(found)) <= rest:
            break
        found.append(r["content"])
        rest -= r["bytes"]
    return found


def shard_documents(
    docs: DataFrame,
    shards: int = 24,
    id_column: str = "doc_id",
    text_column: str = "text",
    n_chars_column: str = "n_chars",
    source_column: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    raw = F.encode(text_of(text_column), "UTF-8")
    source = F.coalesce(F.conv(F.substring(F.hex(F.encode(F.rpad(F.coalesce(F.col(source_column), F.lit("")), 7, "\x00"), "UTF-8")), 1, 14), 16, 10).cast("long"), F.lit(0))
    rows = stored(
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.unhex(F.md5(raw)).alias("content"),
            F.coalesce(F.col(n_chars_column).cast("long"), F.lit(0)).alias("n_chars"),
            source.alias("source"),
        ),
        "shard-rows",
    )
    groups = stored(
        rows.groupBy("content").agg(
            F.sum("size").alias("bytes"),
            F.coalesce(F.min("doc_id"), F.lit(0)).alias("d0"),
            F.max("size").alias("d1"),
            F.max("n_chars").alias("d2"),
            F.min("source").alias("d3"),
        ),
        "shard-groups",
    )
    dims = 4
    ends = groups.agg(*[f(f"d{d}").alias(f"{f.__name__}{d}") for d in range(dims) for f in (F.min, F.max)]).first()
    tie = F.pmod(F.xxhash64("content"), F.lit(1 << 32))

    def key(d: int) -> Column:
        low, span = ends[f"min{d}"] or 0, max(1, (ends[f"max{d}"] or 0) - (ends[f"min{d}"] or 0))
        scaled = F.floor((F.col(f"d{d}") - F.lit(low)) / F.lit(float(span)) * F.lit(float(_SCALE))).cast("long")
        return (scaled * F.lit(1 << 32) + tie).alias(f"k{d}")

    keyed = groups.select("content", "bytes", *[key(d) for d in range(dims)])
    own = oversized(groups, shards)
    small = keyed.where(~F.col("content").isin([F.lit(c) for c in own])) if own else keyed
    cuts, leaves = grow_tree(small, dims, shards - len(own))
    leaf = _choose({}, cuts)
    number = F.element_at(F.create_map(*[F.lit(x) for kv in leaves.items() for x in (kv[0], kv[1] + len(own))]), leaf)
    for i, content in enumerate(own):
        number = F.when(F.col("content") == F.lit(content), F.lit(i)).otherwise(number)
    placed = rows.select("doc_id", "size", "text_crc32", "content").join(keyed.select("content", number.alias("shard")), "content").drop("content")
    return with_slots(placed, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def with_slots(placed: DataFrame, shards: int) -> DataFrame:
    """Adds slot: rows of a shard numbered from 0 without a gap, however large the shard."""
    placed = stored(placed, "shard-placed")
    buckets = max(1, -(-placed.count() // (BUCKET * shards)))
    bucket = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(buckets)).alias("bucket")
    dealt = placed.select("*", bucket)
    offsets = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return dealt.withColumn("at", within).join(offsets, ["shard", "bucket"]).withColumn("slot", (F.col("at") + F.col("before")).cast("long"))
