"""Bounded, repeatable samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_column: str,
    learn: Column,
    per_class: int,
    max_bytes: int,
    columns: tuple[str, ...] = ("text",),
    id_column: str = "doc_id",
) -> list:
    """Rows (*columns, label) of at most ``per_class`` documents of each class 0 and 1, whole texts of at most ``max_bytes``.

    ``learn`` says by the id which labels may be seen. Ids are taken in the order of a hash, from the
    narrow label table; only the chosen ids (a bounded number) are sent to the documents. Of rows that
    repeat an id the smallest text takes part. Null labels and null texts are left out.
    """
    known = labels.where(learn & F.col(label_column).isin(0, 1)).select(F.col(id_column).alias("k"), F.col(label_column).cast("int").alias("label"))
    order = F.xxhash64("k", F.lit(2))
    parts = [known.where(F.col("label") == y).orderBy(order, "k").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]).dropDuplicates(["k"]))
    fit = docs.where(F.octet_length("text") <= max_bytes).select(F.col(id_column).alias("k"), *columns)
    one = fit.join(chosen, "k").groupBy("k", "label").agg(F.min(F.struct(*columns)).alias("row"))
    return sorted(one.select("k", "row.*", "label").collect(), key=lambda r: r["k"])
