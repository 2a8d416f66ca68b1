"""Deduplication of resources and exclusion of failed URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def keep_last_origin(resources: DataFrame) -> DataFrame:
    """One row per resource: its last origin, at its first place.

    Both aggregates combine on the map side, so a resource that most pages load
    reaches the shuffle once per input partition.
    """
    return resources.groupBy("resource_url").agg(
        F.max_by("origin_url", "seq").alias("origin_url"), F.min("seq").alias("seq")
    )


def keep_first_origin(resources: DataFrame) -> DataFrame:
    """One row per resource: its first origin, at its first place."""
    return resources.groupBy("resource_url").agg(
        F.min_by("origin_url", "seq").alias("origin_url"), F.min("seq").alias("seq")
    )


def without_failed(resources: DataFrame, failed: DataFrame) -> DataFrame:
    """Drop resources whose address failed before."""
    known = failed.select(F.col("url").alias("resource_url"))
    return resources.join(known, "resource_url", "left_anti")
