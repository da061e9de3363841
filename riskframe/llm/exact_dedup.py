"""Exact duplicates by content hash, checked byte by byte, with built-in functions only.

Texts are grouped by (128-bit hash, text). The hash leads, so rows are dealt out and sorted by 16
bytes; the text follows, so equal hashes with different bytes end in different groups. Equal texts
are summed inside each input task before the shuffle: a group of copies that holds a third of all
rows sends one row per task. Rows then meet their group on (hash, SHA-256) without their text; a
hot group there is an ordinary skewed join that adaptive execution splits.

Null texts count as empty. A null id never stays unless its group has no other; rows repeated with
one id and one text all carry the decision of that id. Columns other than id and text are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import text_of


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def duplicate_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "min",
    content_hash: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` names the id that stays, ``min`` or ``max``. ``content_hash`` may collide: different
    texts never share a group.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    rows = rows.select("doc_id", "text", content_hash(F.col("text")).alias("content"), F.sha2("text", 256).alias("text_sha256"))
    pick = {"min": F.min, "max": F.max}[keep]
    texts = (
        rows.groupBy("content", "text")
        .agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("content", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    return (
        rows.drop("text")
        .join(texts, ["content", "text_sha256"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def keep_one(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "min",
    content_hash: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """The rows of ``docs`` that stay, whole, exactly one per distinct text (repeated rows fold into one).

    Rows of equal text and id are told apart by their other columns; those that hold maps by their JSON.
    """
    best = {"min": F.min, "max": F.max}[keep]
    text, key = text_of(text_column), F.col(f"`{id_column}`")
    null_last = key.isNull() if keep == "min" else key.isNotNull()
    fields = {c: F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_column}
    row = F.struct(null_last.alias("n"), key.alias("k"), *fields.values(), F.col(f"`{text_column}`").isNotNull().alias("t"))
    maps = {c for c in fields if "map<" in docs.schema[c].dataType.simpleString()}
    chosen = best(row)
    if maps:
        by = F.struct(null_last, key, *(F.to_json(F.struct(f"`{c}`")) if c in maps else F.col(f"`{c}`") for c in fields), F.col(f"`{text_column}`").isNotNull())
        chosen = {"min": F.min_by, "max": F.max_by}[keep](row, by)
    kept = docs.groupBy(content_hash(text).alias("content"), text.alias("body")).agg(chosen.alias("row"))
    body = F.when(F.col("row.t"), F.col("body"))
    return kept.select(*[(body if c == text_column else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])
