"""Groups larger than a fair shard get a shard of their own; the others fill all the rest evenly."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskframe.llm.sharding import shard_documents


@pytest.mark.parametrize("hot", [1, 3])
def test_shards_beside_hot_groups_are_even(spark, hot):
    """``hot`` texts hold a third of all rows and bytes."""
    text = F.when(F.col("id") % 3 == 0, F.format_string("hot%04d", F.floor(F.col("id") / 3) % hot)).otherwise(F.format_string("%07d", "id"))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(text, 20).alias("text"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"), (F.col("id") % 11).alias("n_chars"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    size, where = Counter(), defaultdict(set)
    for r in shard_documents(docs, shards=24).collect():
        size[r["shard"]] += r["size"]
        where[texts[r["doc_id"]]].add(r["shard"])
    assert set(size) == set(range(24)) and all(len(s) == 1 for s in where.values())
    own = {s for t, at in where.items() if t.startswith("hot") for s in at}
    rest = sum(b for s, b in size.items() if s not in own) / (24 - hot)
    assert len(own) == hot and sum(size[s] for s in own) == sum(size.values()) // 3
    assert all(abs(b - rest) < 0.1 * rest for s, b in size.items() if s not in own)


@pytest.mark.parametrize("sizes", [[900, 300, 40, 30, 20, 10], [50, 50, 50], [7] * 9, [1000, 1, 1, 1, 1]])
def test_no_shard_is_empty_where_groups_suffice(spark, sizes):
    docs = spark.createDataFrame([(i, chr(97 + i) * n, "s", n) for i, n in enumerate(sizes)], "doc_id long, text string, source string, n_chars long")
    found = {r["shard"] for r in shard_documents(docs, shards=5).collect()}
    assert len(found) == min(5, len(sizes)) and found <= set(range(5))
