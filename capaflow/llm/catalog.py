"""Queries over the test tables, one per operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capaflow.llm import (chat_format, fingerprints, hard_negatives, html_text, language_id, lexical_search, licence_scan,
                          minmax_dedup, mixing, pstable_dedup, quality_classifier, secret_scan, sentencepiece_bpe)
from capaflow.llm.common import held_out, table
from capaflow.llm.oracles import ORACLES  # noqa: F401

TOKENIZER_MODEL = "piece_bpe_32k.model"


def model_path(name: str = TOKENIZER_MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence that a document's whole text is, with the digest of its canonical form."""
    return licence_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = language_id.fit(docs.where(~held_out("doc_id")))
    return (language_id.predict(docs, filters)
            .select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "explained"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprint of every document and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = fingerprints.fingerprints(docs)
    return df.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                     fingerprints.packed(F.col("sketch")).alias("fingerprint"),
                     fingerprints.packed(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def op5_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document on word pairs at a resemblance of 0.8."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minmax_dedup.near_duplicates(docs, size=2).withColumnRenamed("id", "doc_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs.where(~held_out("doc_id")), table(spark, sf_dir, "labels"))
    return quality_classifier.predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the base kinds and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("_spans")
    base = F.filter(spans, lambda x: x["k"] < len(secret_scan.BASE_RULES))

    def count(kind: int):
        return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(secret_scan.BASE_RULES)]
    return secret_scan.scan(docs).select(
        "doc_id", *counts, F.sha2(secret_scan.named(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.named(spans).alias("spans"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document for a mix of all sources at the target weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of embeddings with a cosine of 0.9 or more."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return pstable_dedup.near_duplicates(vectors).withColumnRenamed("id", "vec_id")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_bpe.encode_decode(docs, model_path(), digests=True)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.ranked(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


#: A conversation that holds the template's own control strings, an escaped one among them.
CONFLICT_ID, CONFLICT_TEXT = -7, r"\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what is read back from its formatted text and loss mask."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conflict = spark.range(2).select(F.lit(CONFLICT_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                     F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT_TEXT).alias("text"))
    done = chat_format.format_chats(rows.unionByName(conflict)).withColumn("loss", chat_format.masked_text(F.col("read"), F.col("mask")))
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive among the embeddings."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), is_anchor="vec_id % 100 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licences": op1_licences,
    "op2_html_text": op2_html_text,
    "op3_language_id": op3_language_id,
    "op4_fingerprints": op4_fingerprints,
    "op5_minmax_near_dedup": op5_minmax_near_dedup,
    "op6_quality": op6_quality,
    "op7_secrets": op7_secrets,
    "op8_mix_sources": op8_mix_sources,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_chat_format": op12_chat_format,
    "op13_hard_negatives": op13_hard_negatives,
}
