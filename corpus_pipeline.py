"""The corpus pipeline: documents to token ids, in five stages.

``STAGES`` are applied one after the other; each result is stored and read again
as the documents of the next. The last one returns the ids with the identity of their
document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from secretsift.llm import lines, mixing, near, pieces, quality
from secretsift.llm.common import stored, table
from secretsift.llm.queries import digest, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither their own text nor their host condemns."""
    return quality.reject_low_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines stay in the document with the largest id only."""
    return lines.drop_frequent_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles."""
    return near.keep_one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a mix of the sources to target weights takes, one row per pass over a document."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the text decoded from them."""
    out = pieces.encode_texts(docs, tokenizer_path())
    return out.select(
        "row.doc_id", "row.lang", "row.source", "row.n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("tokenize", tokenize),
]

# Pseudorandom mixing and tokenizing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
