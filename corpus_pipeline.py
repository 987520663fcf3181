"""The corpus pipeline: from raw documents to tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``. A stage works on all rows that the one
before kept, and what it decides is what the next one gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capaflow.llm import language_id, minmax_dedup, mixing, secret_scan, sentencepiece_bpe
from capaflow.llm.catalog import model_path
from capaflow.llm.common import exactly, held_out, staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of a text's n-grams that its language must know. Clean texts are far above.
LEAST_EXPLAINED = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language; texts without letters and texts that no language explains go.

    Learnt from the labelled, not held-out rows of ``docs``. Without any label nothing is rejected.
    """
    docs = exactly(docs, *COLUMNS)
    filters = language_id.fit(docs.where(~held_out("doc_id")))
    if not filters.languages:
        return docs
    found = language_id.predict(docs, filters, keep=COLUMNS)
    return exactly(found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("explained") >= LEAST_EXPLAINED)), *COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five words at a resemblance of 0.8: the one with the smallest id.

    Rows without an id are kept once per text. An id that occurs again is the same document.
    """
    docs = exactly(docs, *COLUMNS)
    kept = minmax_dedup.near_duplicates(docs).where("kept and id is not null").select(F.col("id").alias("doc_id"))
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    nameless = docs.where("doc_id is null").withColumn("_h", F.xxhash64("text")).dropDuplicates(["_h"]).drop("_h")
    return exactly(named, *COLUMNS).union(nameless)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; n_chars follows."""
    found = secret_scan.scan(exactly(docs, *COLUMNS), keep=COLUMNS)
    clean = secret_scan.redacted(F.col("_text"), F.col("_spans"))
    hit = F.size("_spans") > 0
    return exactly(found.withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
                   .withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))), *COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 2 times)."""
    return mixing.repeated(exactly(docs, *COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_tokens and the digests of its ids and of what they decode to."""
    return sentencepiece_bpe.encode_decode(exactly(docs, *COLUMNS), model_path(), digests=True)


STAGES = [
    ("language_id", identify_language),
    ("minmax_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("sentencepiece", tokenize),
]
#: SQL can express neither the language filters nor the rounding nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
