"""Seed domains: the list of domains a scan is about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from secretsift.functions.urls import host_of, normalise_domain
from secretsift.operators.domains import with_domain_parts
from secretsift.session import INTENDED, REFERENCE, check_semantics
from secretsift.sources.suffixes import SuffixRules


def read_seed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a seed file; the text reader drops a byte-order mark itself."""
    return spark.read.text(path)


def seed_domains(
    lines: DataFrame, rules: SuffixRules, semantics: str = REFERENCE
) -> DataFrame:
    """Table ``(domain, label)`` of one seed per usable line of column ``value``.

    Lines starting with ``#`` and blank lines are skipped. ``reference`` keeps a
    line without a registered domain as an empty seed and keeps repeats;
    ``intended`` drops both and lets one line hold several domains.
    """
    intended = check_semantics(semantics) == INTENDED
    value = F.regexp_replace("value", "^\ufeff", "")
    kept = lines.where(~F.startswith(value, F.lit("#")))
    entry = F.explode(F.split(value, ",")) if intended else value
    named = kept.select(entry.alias("entry")).select(normalise_domain(F.col("entry")).alias("entry"))
    hosts = named.where(F.length("entry") > 0).select(host_of(F.col("entry")).alias("host"))
    seeds = with_domain_parts(hosts, "host", rules, registered="domain").select("domain")
    if intended:
        seeds = seeds.where(F.length("domain") > 0).distinct()
    return seeds.select("domain", F.substring_index("domain", ".", 1).alias("label"))
