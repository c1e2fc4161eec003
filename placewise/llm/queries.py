"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, exact_dedup, hamming, near_dedup, packing, secrets, sentencepiece, toxicity, urls, warc, whitening
from ._shared import held_out, small, table


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """Fitted to the labelled documents that are not held out; of labels that repeat a document, the largest counts."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("toxic").alias("toxic"))
    train = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    train = train.join(small(labels), F.col("doc_id") == F.col("labelled"))
    return toxicity.fit(train, label_col="toxic", key=F.col("doc_id"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return pages.select("page_id", "host", "path", "rule", "verdict")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hamming.top_k(vectors, F.col("vec_id") % 50 == 0)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), threshold_pct=85)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("found")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    rows = whitening.transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*map(F.lit, model.explained)).cast("array<double>")
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    found = conversations.repair(rows, present=F.col("present"))
    return found.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filter": op2_url_filter,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_hamming_search": op6_hamming_search,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_warc": op9_warc,
    "op10_secrets": op10_secrets,
    "op11_whitening": op11_whitening,
    "op12_conversations": op12_conversations,
    "op13_bpe": op13_bpe,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": urls.oracle_sql(),
    "op6_hamming_search": """
        WITH bits AS (SELECT vec_id, CAST(list_sum(list_transform(range(1, 33), lambda i:
                CASE WHEN embedding[i] > 0 THEN CAST(1 AS UBIGINT) << (i - 1) ELSE 0 END)) AS UBIGINT) AS lo,
              CAST(list_sum(list_transform(range(33, 65), lambda i:
                CASE WHEN embedding[i] > 0 THEN CAST(1 AS UBIGINT) << (i - 33) ELSE 0 END)) AS UBIGINT) AS hi
            FROM embeddings),
          pairs AS (SELECT q.vec_id, b.vec_id AS neighbor_id,
              CAST(bit_count(xor(q.lo, b.lo)) AS INTEGER) + CAST(bit_count(xor(q.hi, b.hi)) AS INTEGER) AS distance
            FROM bits q JOIN bits b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0)
        SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance FROM (
          SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
        WHERE rank <= 10""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
          d AS (SELECT *, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS b, max(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
          list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + 16 * CAST(b[5 * i + 1] AS INTEGER) + 8 * CAST(b[5 * i + 2] AS INTEGER) + 4 * CAST(b[5 * i + 3] AS INTEGER)
            + 2 * CAST(b[5 * i + 4] AS INTEGER) + CAST(b[5 * i + 5] AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
          CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
