"""Mixing sources to target weights by pivotal dependent rounding, with built-in functions only.

Every source gets a target number of words; each of its documents is expected target / source words
times. The whole part is taken as copies; the fraction p is rounded by pivotal sampling: two
documents trade words (one's p rises by m / words, the other's falls by m / words) until one of them
is 0 or 1, in a direction drawn so that no expectation moves. Every trade keeps the words of the
source, so a source misses its target by less than the words of its one last document.

The trades run as a reduction tree. Documents are dealt by a hash of their row into chunks of about
``CHUNK`` within their source, each chunk is folded to one undecided document, and these go up to
the next level until one per source is left. No chunk grows with its source. A chunk is folded from
long to short texts, so that long ones trade with their like and the last one is mostly short.

Null sources form a source of their own, ordered last. Null texts and texts without a word have
size 0 and take nothing. Repeated rows, also such without id, are decided one by one; those that agree
in every column are numbered, since nothing else tells them apart. All columns are read for that, map
columns as JSON. Sources are ranked and their caps summed in ranges, not in one window over all sources.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.prefix import running
from riskframe.llm.common import stored, text_of, word_count

CHUNK = 64
SEED = 20_260

#: A row of the table: what it agrees in with others, and its number among those that agree in all.
_UNIT = "struct<doc_id:bigint,size:bigint,row:bigint,i:bigint>"
#: One trade. acc: the undecided row (null before the first) and the decided ones; e: the next.
_TRADE = f"""
aggregate(items, named_struct('unit', cast(null as {_UNIT}), 'w', cast(null as double), 'p', cast(null as double), 'done', cast(array() as array<struct<unit:{_UNIT},up:int>>)),
  (acc, e) -> CASE
    WHEN acc.w IS NULL THEN named_struct('unit', e.unit, 'w', e.w, 'p', e.p, 'done', acc.done)
    WHEN e.u * (least((1 - acc.p) * acc.w, e.p * e.w) + least(acc.p * acc.w, (1 - e.p) * e.w)) < least(acc.p * acc.w, (1 - e.p) * e.w) THEN
      CASE WHEN (1 - acc.p) * acc.w <= e.p * e.w
        THEN named_struct('unit', e.unit, 'w', e.w, 'p', greatest(0D, e.p - (1 - acc.p) * acc.w / e.w), 'done', concat(acc.done, array(named_struct('unit', acc.unit, 'up', 1))))
        ELSE named_struct('unit', acc.unit, 'w', acc.w, 'p', least(1D, acc.p + e.p * e.w / acc.w), 'done', concat(acc.done, array(named_struct('unit', e.unit, 'up', 0)))) END
    ELSE
      CASE WHEN acc.p * acc.w <= (1 - e.p) * e.w
        THEN named_struct('unit', e.unit, 'w', e.w, 'p', least(1D, e.p + acc.p * acc.w / e.w), 'done', concat(acc.done, array(named_struct('unit', acc.unit, 'up', 0))))
        ELSE named_struct('unit', acc.unit, 'w', acc.w, 'p', greatest(0D, acc.p - (1 - e.p) * e.w / acc.w), 'done', concat(acc.done, array(named_struct('unit', e.unit, 'up', 1)))) END
  END)
"""


def row_hash(docs: DataFrame) -> Column:
    """Hash of a whole row; columns that hold maps by their JSON."""
    names = [f"`{c}`" for c in docs.columns]
    held = {f"`{f.name}`" for f in docs.schema.fields if "map<" in f.dataType.simpleString()}
    return F.xxhash64(*[F.to_json(F.struct(c)) if c in held else F.col(c) for c in names])


def _along(table: DataFrame, order: Column, sums: list[str]) -> DataFrame:
    """``table`` with the sums of all earlier rows along ``order`` (``before_<c>``), worked out in ranges of it."""
    ordered = table.withColumn("_order", order)
    ranged = stored(ordered.repartitionByRange(F.col("_order")).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    return running(ranged, [], "_order", "_range", sums=sums).drop("_order", "_range")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target of a table (source, source_size) with one row per source.

    Sources in code point order, null last, weigh ``weights``, repeating. Together they get ``share``
    of all words; none gets over ``cap`` times its own, and what that leaves goes to the others by
    weight. A source is at its cap if, with all sources of a smaller cap per weight at theirs, its
    part by weight would still reach its own.
    """
    n = len(weights)
    placed = _along(sizes.withColumn("one", F.lit(1)), F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))), ["one"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before_one") % n + 1).cast("int"))
    ranked = placed.select("source", "source_size", F.col("before_one").alias("rank"), weight.alias("w"), (F.col("source_size") * F.lit(float(cap))).alias("most"))
    filled = _along(ranked, F.struct(F.col("most") / F.col("w"), "rank"), ["most", "w"])
    total, all_w = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    budget = float(total * share)
    level = (F.lit(budget) - F.col("before_most")) / (F.lit(all_w) - F.col("before_w"))
    filled = filled.withColumn("capped", F.col("most") <= F.col("w") * level)
    spent, free = filled.agg(F.sum(F.when(F.col("capped"), F.col("most"))), F.sum(F.when(~F.col("capped"), F.col("w")))).first()
    rest = F.lit((budget - (spent or 0.0)) / free if free else 0.0)
    return filled.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.col("w") * rest).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, row (hash of all columns), source_size, target, copies, taken (= copies x size)."""
    size = word_count(text_of(text_column))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).alias("source"), size.alias("size"), row_hash(docs).alias("row"))
    units = stored(rows.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("m")), "mix-units")
    sources = stored(
        source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), weights, share, cap), "mix-sources"
    )
    s = sources.select(F.col("source").alias("s"), "source_size", "target")
    single = units.select("source", "doc_id", "size", "row", F.explode(F.expr("sequence(1L, m)")).alias("i"))
    placed = single.join(s, single["source"].eqNullSafe(s["s"])).drop("s")
    x = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = placed.withColumn("p", x - F.floor(x)).select("source", F.struct("doc_id", "size", "row", "i").alias("unit"), F.col("size").cast("double").alias("w"), "p")
    whole = placed.where("p = 0").select("source", "unit", F.lit(0).alias("up"))
    left = placed.where("p > 0")
    decided, level = [whole], 0
    while True:
        tag = F.xxhash64("unit", F.lit(seed), F.lit(level))
        counts = left.groupBy("source").agg(F.count("*").alias("n"))
        c = counts.select(F.col("source").alias("s"), F.ceil(F.col("n") / CHUNK).alias("chunks"))
        dealt = left.join(c, left["source"].eqNullSafe(c["s"])).drop("s").withColumn("tag", tag)
        dealt = dealt.withColumn("u", F.pmod(F.xxhash64("tag", F.lit(seed + 1)), F.lit(1 << 53)) / F.lit(float(1 << 53)))
        item = F.struct("w", "tag", "unit", "p", "u")
        folded = dealt.groupBy("source", F.pmod("tag", "chunks").alias("chunk")).agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
        folded = stored(folded.select("source", F.expr(_TRADE).alias("r")), f"mix-level{level}")
        decided.append(folded.select("source", F.explode("r.done").alias("d")).select("source", "d.unit", "d.up"))
        left = folded.select("source", "r.unit", "r.w", "r.p")
        most = left.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if (most or 0) <= 1:
            break
        level += 1
    last = F.pmod(F.xxhash64("unit", F.lit(seed), F.lit("last")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    decided.append(left.select("source", "unit", (last < F.col("p")).cast("int").alias("up")))
    every = decided[0]
    for d in decided[1:]:
        every = every.unionByName(d)
    every = every.select("source", "unit.doc_id", "unit.size", "unit.row", "up")
    out = every.join(s, every["source"].eqNullSafe(s["s"])).withColumn("copies", (F.floor(x) + F.col("up")).cast("int"))
    return out.select("doc_id", "source", "size", "row", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def taken_documents(docs: DataFrame, mixed: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` takes them, with the columns of ``docs``.

    Rows that agree in every column are one row here, taken as often as all of them.
    """
    keys = ("doc_id", "source", "size", "row")
    taken = stored(mixed.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0"), "mix-taken")
    m = taken.select(*[F.col(c).alias(f"_mix_{c}") for c in (*keys, "copies", "rows")])
    whole = docs.withColumn("_mix_own", row_hash(docs))
    same = whole[id_column].eqNullSafe(m["_mix_doc_id"]) & whole[source_column].eqNullSafe(m["_mix_source"]) & (whole["_mix_own"] == m["_mix_row"])
    same = same & (word_count(text_of(text_column)) == m["_mix_size"])
    joined = whole.join(m.where("_mix_rows = 1"), same)
    if not m.where("_mix_rows > 1").isEmpty():
        joined = joined.unionByName(whole.join(m.where("_mix_rows > 1"), same).dropDuplicates([f"_mix_{c}" for c in keys]))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))).alias("_mix_copy")).drop("_mix_copy")
