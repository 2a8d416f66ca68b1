"""Rank URLs by the words they hold and cut the list at a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from secretsift.functions.patterns import HIGH, INTERNAL, LOW, MEDIUM, RESOURCE, TIER_NAMES, matches_any
from secretsift.operators.topk import PLAIN_LIMIT, first_rows
from secretsift.session import REFERENCE, cut_lineage


def internal_tier(url: Column, semantics: str = REFERENCE) -> Column:
    """High or low rank of an internal URL."""
    high = matches_any(url, INTERNAL, HIGH, semantics)
    return F.when(high, F.lit(HIGH)).otherwise(F.lit(LOW))


def resource_tier(url: Column, semantics: str = REFERENCE) -> Column:
    """High, medium or low rank of a resource URL; the first that matches counts."""
    return (
        F.when(matches_any(url, RESOURCE, HIGH, semantics), F.lit(HIGH))
        .when(matches_any(url, RESOURCE, MEDIUM, semantics), F.lit(MEDIUM))
        .otherwise(F.lit(LOW))
    )


def tier_name(tier: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in TIER_NAMES.items() for x in kv])
    return F.try_element_at(names, tier)


def rank_internal(links: DataFrame, semantics: str = REFERENCE) -> DataFrame:
    """Distinct internal URLs with rank and first place: ``url, tier, seq``."""
    first = links.groupBy("url").agg(F.min(F.struct("page_id", "tag_no")).alias("seq"))
    return first.select("url", internal_tier(F.col("url"), semantics).alias("tier"), "seq")


def rank_resources(resources: DataFrame, semantics: str = REFERENCE) -> DataFrame:
    """Add ``tier`` to deduplicated resources."""
    return resources.withColumn("tier", resource_tier(F.col("resource_url"), semantics))


def select_first(
    ranked: DataFrame, limit: int | None = None, plain: int = PLAIN_LIMIT, lead: str = "page_id"
) -> DataFrame:
    """The ``limit`` best URLs: high before medium before low, then first seen; all without a limit.

    Needs ``tier`` and ``seq``, whose first field is the number ``lead``. Beyond ``plain``
    the ranked list is written out once, because the selection reads it again.
    """
    if limit is None:
        return ranked
    if limit <= plain:
        return first_rows(ranked, "tier", f"seq.{lead}", ["seq"], limit, plain)
    stored = cut_lineage(ranked.withColumn("_lead", F.col(f"seq.{lead}")))
    return first_rows(stored, "tier", "_lead", ["seq"], limit, plain).drop("_lead")


def priority_distribution(
    ranked: DataFrame, total: DataFrame, limit: int | None = None
) -> DataFrame:
    """Found and selected URLs per rank: ``tier, found, found_pct, selected, selected_pct``.

    ``total`` holds one number ``n``, the URLs before deduplication, which the
    share of found URLs refers to. Selected counts follow from the found ones.
    """
    counts = ranked.agg(*[
        F.count_if(F.col("tier") == t).alias(name) for t, name in TIER_NAMES.items()
    ])
    high, medium, low = (F.col(TIER_NAMES[t]) for t in (HIGH, MEDIUM, LOW))
    size = high + medium + low if limit is None else F.lit(limit).cast("long")
    left = lambda used: F.greatest(size - used, F.lit(0))
    selected = {
        HIGH: F.least(high, size),
        MEDIUM: F.least(medium, left(high)),
        LOW: F.least(low, left(high + medium)),
    }
    share = lambda n, of: F.round(F.try_divide(n * 100, of), 1)
    used = F.least(high + medium + low, size)
    rows = F.array(*[
        F.struct(
            F.lit(TIER_NAMES[t]).alias("tier"),
            F.col(TIER_NAMES[t]).alias("found"),
            share(F.col(TIER_NAMES[t]), F.col("total")).alias("found_pct"),
            selected[t].alias("selected"),
            share(selected[t], used).alias("selected_pct"),
        )
        for t in (HIGH, MEDIUM, LOW)
    ])
    return counts.withColumn("total", total.select("n").scalar()).select(F.inline(rows))
