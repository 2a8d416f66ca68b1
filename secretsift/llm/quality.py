"""Host-level quality rules, in Spark SQL functions only.

Every document is tested on its own first. The share of failures of each host is
shrunk towards all hosts by a beta prior fitted to them (method of moments), so
a host of few documents is not condemned by them alone; documents of a host whose
shrunk rate reaches ``max_rate`` are rejected with it.

Defined results: a null text counts as empty and fails (it has no words); a null
host is one host of its own; repeated rows are judged row by row and all count;
an empty table gives an empty result. Input columns travel in one struct, so
their names cannot clash with those made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from secretsift.functions.text import let
from secretsift.llm.common import SPACE, WORD, stored, whole

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_HOST_RATE = 0.5
# Strength of the prior, in documents: its least and its most.
PRIOR_LEAST, PRIOR_MOST = 1.0, 1e6
# Host verdicts are broadcast up to this many hosts with names of this many bytes.
BROADCAST_HOSTS, BROADCAST_BYTES = 100_000, 8_000_000
SALTS = 32

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(windows: Column) -> Column:
    """Words inside windows whose hash occurs at least twice, each word once."""

    def covered(ranked: Column) -> Column:
        again = F.filter(ranked, lambda e, i: (e["hash"] == F.get(ranked, i - 1)["hash"])
                         | (e["hash"] == F.get(ranked, i + 1)["hash"]))
        starts = F.sort_array(F.transform(again, lambda e: e["at"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, at: F.struct((acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"), at.alias("last")),
            lambda acc: acc["n"],
        )

    placed = F.transform(windows, lambda h, i: F.struct(h.alias("hash"), i.alias("at")))
    # Most texts repeat no window; only the others are sorted.
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(
        let(F.array_sort(placed), covered))


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``df``), the metrics of its text and ``base_failed``."""
    body = whole(F.col(text))
    words = df.select(F.struct("*").alias("row"), body.alias("body"),
                      F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("words"))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD))
    hashed = words.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        (F.length("body") - F.regexp_count("body", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    hashes = F.col("hashes")
    windows = F.when(F.size(hashes) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(hashes) - WINDOW),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
    )).otherwise(F.array().cast("array<bigint>"))
    rolled = hashed.withColumn("windows", windows).drop("hashes")
    out = rolled.withColumn("n_repeat_words", _repeat_words(F.col("windows")).cast("long")).drop("windows")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_quality(df: DataFrame, text: str = "text", host: str = "source",
                 max_rate: float = MAX_HOST_RATE, keep_text: bool = True) -> DataFrame:
    """``row`` of each document with its metrics, its host's rate and ``kept``.

    The metrics are stored once, because hosts and documents both read them;
    without ``keep_text`` the text is not stored with them.
    """
    scored = with_metrics(df, text).withColumn("host", F.col("row")[host])
    if not keep_text:
        scored = scored.withColumn("row", F.col("row").dropFields(text))
    scored = stored(scored)
    hosts = scored.groupBy("host").agg(
        F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    docs, failed = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    total = hosts.agg(
        F.sum(docs).alias("n"), F.sum(failed).alias("f"), F.sum(failed * failed / docs).alias("f2"),
        F.count("*").alias("hosts"), F.sum(F.octet_length("host")).alias("bytes"),
    ).first()
    alpha, beta = beta_prior(total.n or 0.0, total.f or 0.0, total.f2 or 0.0)
    verdicts = hosts.withColumn("host_rate", F.round((failed + alpha) / (docs + alpha + beta), 6))
    if total.hosts <= BROADCAST_HOSTS and (total.bytes or 0) <= BROADCAST_BYTES:
        verdicts = F.broadcast(verdicts)
        judged = scored.join(verdicts, scored.host.eqNullSafe(verdicts.host), "left").drop(verdicts.host)
    else:
        # Any number of hosts, and one of them may hold a third of the documents.
        salted = scored.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        copies = verdicts.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = salted.join(
            copies, salted.host.eqNullSafe(copies.host) & (salted.salt == copies.copy), "left",
        ).drop(copies.host).drop("salt", "copy")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") < max_rate))


def beta_prior(docs: float, failed: float, failed_squared_by_docs: float) -> tuple[float, float]:
    """Beta prior with the mean and the variance of the hosts' failure rates."""
    if not docs:
        return 0.0, PRIOR_LEAST
    mean = failed / docs
    spread = failed_squared_by_docs / docs - mean * mean
    strength = mean * (1 - mean) / spread - 1 if spread > 1e-12 else PRIOR_MOST
    strength = min(max(strength, PRIOR_LEAST), PRIOR_MOST)
    return mean * strength, (1 - mean) * strength


def reject_low_quality(df: DataFrame, text: str = "text", host: str = "source",
                       max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``df`` without the documents that their own text or their host condemns."""
    return host_quality(df, text, host, max_rate).where("kept").select("row.*")
