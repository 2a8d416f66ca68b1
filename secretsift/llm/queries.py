"""One query per operator over its whole table, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from secretsift.llm import (
    alignment, language, lines, mixing, near, pieces, quality, spans, syncmers, templates, toxicity, warc, whitening)
from secretsift.llm.common import table
from secretsift.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

TOKENIZER, BYTE_TOKENIZER = "piece_bpe_32k.model", "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    return public_tokenizers.path(name)


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", *columns)


def _fold(key: Column, of: int) -> Column:
    return F.crc32(key.cast("string")) % of


def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Document metrics and the verdict of host-level quality rules."""
    judged = quality.host_quality(documents(spark, folder, "source"), keep_text=False)
    return judged.select(F.col("row.doc_id").alias("doc_id"), *quality.METRICS, "base_failed", "host_rate", "kept")


def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of sources to target weights takes of each document."""
    mix = mixing.mix(documents(spark, folder, "source"), keep_text=False)
    taken = mix.taken.groupBy("row_id").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    docs = mixing.with_plan(mix.docs.join(taken.hint("merge"), "row_id", "left"), mix.sources, "source_size", "target")
    return docs.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                       F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the word runs that occur earlier."""
    out = spans.dedup_substrings(documents(spark, folder))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", digest(F.col("kept")).alias("kept_sha256"))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labels."""
    out = toxicity.toxicity(
        documents(spark, folder), table(spark, folder, "labels").select("doc_id", "toxic"),
        _fold(F.col("doc_id"), 5) != 0)
    key, score = F.col("row.doc_id"), F.col("score")
    return out.select(key.alias("doc_id"), (_fold(key, 5) == 0).alias("held_out"), "score",
                      (score >= 0.5).cast("int").alias("predicted"))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose two-word shingle sets have similarity 0.8 or more."""
    out = near.near_duplicates(documents(spark, folder), shingle=2)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document and the text decoded from them."""
    out = pieces.encode_texts(documents(spark, folder), tokenizer_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select(F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                      digest(ids).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    out = language.identify_languages(documents(spark, folder, "lang"), _fold(F.col("doc_id"), 3) != 1)
    key = F.col("row.doc_id")
    return out.select(key.alias("doc_id"), (_fold(key, 3) == 1).alias("held_out"),
                      F.col("language").alias("lang_pred"), "score")


def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    out = syncmers.edited_neighbours(documents(spark, folder))
    return out.select(
        "doc_id", "n_chars", digest(F.col("edited")).alias("edited_sha256"),
        syncmers.fingerprint(F.col("pairs")).alias("fingerprint"),
        syncmers.fingerprint(F.col("edited_pairs")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("bag"), F.col("edited_bag")).alias("near_edited"),
        syncmers.likeness(F.col("bag"), F.col("next_bag")).alias("near_next"))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that a later document keeps."""
    out = lines.dedup_lines(documents(spark, folder))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", digest(F.col("kept")).alias("kept_sha256"))


def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Archives of all pages, written and read back."""
    read = warc.archive_pages(table(spark, folder, "pages").select("page_id", "url", "html"))
    response = F.col("record_type") == "response"
    return read.select(
        warc.page_id(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", warc.page_id(F.col("refers_to")).alias("refers_to"))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    out = templates.main_texts(table(spark, folder, "pages").select("page_id", "url", "html"), keep_html=False)
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document."""
    out = alignment.align_texts(documents(spark, folder), tokenizer_path(BYTE_TOKENIZER), tokenizer_path(),
                                keep_groups=False, keep_text=False)
    return out.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      F.col("groups").alias("groups_sha256"))


def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened components of every usable embedding."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return whitening.by_component(whitening.whiten(vectors)).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_quality": op1,
    "op2_source_mix": op2,
    "op3_substring_dedup": op3,
    "op4_toxicity": op4,
    "op5_near_duplicates": op5,
    "op6_sentencepiece": op6,
    "op7_language": op7,
    "op8_fingerprints": op8,
    "op9_line_dedup": op9,
    "op10_warc": op10,
    "op11_main_text": op11,
    "op12_token_alignment": op12,
    "op13_whitening": op13,
}
