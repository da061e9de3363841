"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.centroids import cluster_vectors
from riskframe.llm.common import crc_fold, table
from riskframe.llm.exact_dedup import duplicate_groups
from riskframe.llm.html_text import extract_pages
from riskframe.llm.lattice_lm import score_texts
from riskframe.llm.maxscore import top_k
from riskframe.llm.mixing import mix_sources
from riskframe.llm.pieces import token_digests
from riskframe.llm.quality import fit_quality, score_quality
from riskframe.llm.rounds_sql import centroids_sql, codes_sql
from riskframe.llm.sharding import shard_documents
from riskframe.llm.simhash import near_duplicates
from riskframe.llm.token_counts import token_counts
from riskframe.llm.toxicity import fit_network, flag_by_language, language_thresholds, scores_only
from riskframe.llm.vector_codes import compress_vectors


def piece_model() -> str:
    """Place of the vocabulary file; it is installed with the workers and never copied here."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit_quality(docs, table(spark, sf_dir, "labels"), learn=crc_fold("doc_id", 4) != 2)
    scored = score_quality(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), piece_model())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"), keep="max")


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), piece_model())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc_fold("doc_id", 5)
    labels = table(spark, sf_dir, "labels")
    net, used = fit_network(docs, labels, learn=fold != 0)
    rows = scores_only(docs, net)
    thresholds = {} if isinstance(net, float) else language_thresholds(rows, labels, fold != 0, used)
    scored = flag_by_language(rows, thresholds)
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", predicted, "lang_threshold", "flagged")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = compress_vectors(table(spark, sf_dir, "embeddings"), parts=8, k=16, rounds=6, scale=4096.0)
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_fold("doc_id", 10)
    scored = score_texts(table(spark, sf_dir, "documents"), piece_model(), learn=fold != 0)
    figures = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")
    return scored.select("doc_id", (fold == 0).alias("held_out"), *figures)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64.0, width=64, salt="1")


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_text,
        op2_quality,
        op3_maxscore,
        op4_simhash,
        op5_mix_sources,
        op6_token_counts,
        op7_exact_dedup,
        op8_kd_shards,
        op9_pieces,
        op10_toxicity,
        op11_vector_codes,
        op12_lattice_lm,
        op13_centroids,
    )
}

ORACLES = {
    "op3_maxscore": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.text) AS text_sha256 FROM t JOIN g ON t.text = g.text
    """,
    "op11_vector_codes": codes_sql(parts=8, k=16, rounds=6, scale=4096),
    "op13_centroids": centroids_sql(k=16, rounds=3, scale=64, width=64, salt="1"),
}
