"""Public-suffix rules: a small built-in list and a loader for the full one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from secretsift.functions.text import strip
from secretsift import schemas

# Flags of a rule key, one bit each.
PLAIN, WILDCARD, EXCEPTION, PRIVATE = 1, 2, 4, 8

# Rules beyond this number are joined without a broadcast hint. The public list
# holds about ten thousand.
BROADCAST_RULES = 200_000

# A sample of the public suffix list, for runs without the full file.
ICANN_RULES = (
    "com org net edu gov mil int info biz name io ai app dev co me tv cc cloud online site tech "
    "store xyz de fr es it nl be ch at se no dk fi pl cz eu ru us ca uk co.uk org.uk ac.uk gov.uk "
    "au com.au net.au org.au nz co.nz jp co.jp ne.jp or.jp br com.br in co.in cn com.cn "
    "*.ck !www.ck *.bd *.kawasaki.jp !city.kawasaki.jp"
).split()
PRIVATE_RULES = (
    "github.io gitlab.io herokuapp.com netlify.app vercel.app pages.dev web.app firebaseapp.com "
    "cloudfront.net s3.amazonaws.com azurewebsites.net blogspot.com"
).split()


@dataclass(frozen=True)
class SuffixRules:
    """Rules keyed by the suffix they hang on, with the longest key's label count."""

    table: DataFrame
    depth: int
    small: bool


def _keyed(rules: DataFrame) -> DataFrame:
    """One row per key: ``*.x`` and ``!y`` become flags on ``x`` and ``y``."""
    rule = F.lower(strip(F.col("rule")))
    flag = (
        F.when(F.startswith(rule, F.lit("*.")), F.lit(WILDCARD))
        .when(F.startswith(rule, F.lit("!")), F.lit(EXCEPTION))
        .otherwise(F.lit(PLAIN))
    )
    private = F.when(F.col("private"), F.lit(PRIVATE)).otherwise(F.lit(0))
    return (
        rules.where(F.length(rule) > 0)
        .select(
            F.regexp_replace(rule, r"^(?:\*\.|!)", "").alias("suffix"),
            flag.bitwiseOR(private).alias("flag"),
        )
        .groupBy("suffix")
        .agg(F.bit_or("flag").alias("flags"))
    )


def prepare_rules(rules: DataFrame, include_private: bool = True) -> SuffixRules:
    """Key a table ``(rule, private)``; its size and depth are measured once."""
    chosen = rules if include_private else rules.where(~F.col("private"))
    keyed = _keyed(chosen)
    size, depth = keyed.agg(
        F.count(F.lit(1)), F.max(F.size(F.split("suffix", "[.]")))
    ).first()
    return SuffixRules(keyed, depth or 1, size <= BROADCAST_RULES)


def builtin_rules(spark: SparkSession, include_private: bool = True) -> SuffixRules:
    """The sample above. Its size is known, so no job is needed to measure it."""
    rows: dict[str, int] = {}
    named = [(r, 0) for r in ICANN_RULES] + [(r, PRIVATE) for r in PRIVATE_RULES if include_private]
    for rule, private in named:
        kind = WILDCARD if rule.startswith("*.") else EXCEPTION if rule.startswith("!") else PLAIN
        suffix = rule.removeprefix("*.").removeprefix("!")
        rows[suffix] = rows.get(suffix, 0) | kind | private
    table = spark.createDataFrame(sorted(rows.items()), "suffix string, flags int")
    return SuffixRules(table, max(s.count(".") + 1 for s in rows), True)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a public-suffix-list file as ``(rule, private)``.

    The file is one small document whose second half is the private section, so
    it is read whole and cut at the section mark.
    """
    text = spark.read.text(path, wholetext=True)
    mark = "===BEGIN PRIVATE DOMAINS==="

    def lines(part: Column, private: bool) -> DataFrame:
        line = F.explode(F.split(part, r"\r?\n"))
        return text.select(line.alias("line")).select(
            F.regexp_extract(strip(F.col("line")), r"^(\S*)", 1).alias("rule"),
            F.lit(private).alias("private"),
        )

    public = F.substring_index("value", mark, 1)
    private = F.when(F.contains("value", F.lit(mark)), F.substring_index("value", mark, -1))
    both = lines(public, False).unionByName(lines(F.coalesce(private, F.lit("")), True))
    rows = both.where((F.length("rule") > 0) & ~F.startswith("rule", F.lit("//")))
    return rows.to(schemas.SUFFIX_RULES)
