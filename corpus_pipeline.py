"""A training corpus from raw documents in five stages; each works on all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns
of ``documents``. ``run`` applies them to ``documents``, writing each stage's result and reading it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.llm import exact_dedup, near_dedup, packing, queries, secrets, toxicity
from placewise.llm._shared import Scratch, scratch_area, table

TOXIC = 0.7
NEAR_PCT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC, by a model fitted to the labelled documents that are not held out.

    Null and empty texts score the model's bias and pass unless most labels are toxic; rows are not merged.
    """
    model = queries.toxicity_model(spark, docs, sf_dir)
    plain = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    scored = toxicity.score(plain, model, text_col=f"c{docs.columns.index('text')}")
    return scored.filter(F.col("score") < TOXIC).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest id; of rows that repeat id and text, one. Null and empty texts are equal. An
    empty table gives no rows."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a shingle similarity of 0.8 or more, the document of the smallest id. Null and empty texts are
    linked with nothing and stay; an empty table gives no rows."""
    return near_dedup.keep_first(docs, threshold_pct=NEAR_PCT)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, with secrets in their texts replaced; null and empty texts stay as they are."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset; a null or empty text is one piece, repeated rows are packed each, and an
    empty table gives no rows."""
    return packing.pack(docs, queries.tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: A classifier and a tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's scratch tables, and the result of the stage before it, go when it is written."""
    docs = table(spark, sf_dir, "documents")
    results = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        before = docs
        with scratch_area(spark, name):
            docs = results.cut(stage(spark, before, sf_dir), name)
        results.drop(before)
    return docs
