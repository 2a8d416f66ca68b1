"""Exact first-k selections that never pass a hot group through one task whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from secretsift.session import cut_lineage

# Rows one task may be handed per group in the last steps of a group limit.
GROUP_ROWS = 4_000_000


def first_per_group(
    df: DataFrame, groups: list[str], order: list[str], k: int, spread: int = 1 << 12
) -> DataFrame:
    """The first ``k`` rows of every group in ``order``, which must be unique in it.

    Groups of up to ``k`` rows are kept whole without ranking them. The others, of
    which there are at most one per ``k`` rows, are cut into ``spread`` slices by
    a hash of the order columns, and each slice is limited to ``k`` first. Slices
    then merge, as many at a time as keep one task within ``GROUP_ROWS`` rows,
    down to the group. Any row among the first ``k`` of its group is among the
    first ``k`` of its slice, so nothing is lost, and a group with most of the
    table is sorted by many tasks. The input is read three times and stored first.
    """
    stored = cut_lineage(df)
    sizes = stored.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > k).select(*groups)
    small = stored.join(large, groups, "left_anti")
    kept = stored.join(large, groups, "left_semi")
    fan_in = max(2, GROUP_ROWS // max(k, 1))
    slices = [spread]
    while slices[-1] > 1:
        slices.append(-(-slices[-1] // fan_in))
    kept = kept.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(spread)))
    for width in slices:
        kept = kept.withColumn("_slice", F.pmod("_slice", F.lit(width)))
        ranked = Window.partitionBy(*groups, "_slice").orderBy(*order)
        kept = kept.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= k)
    return small.unionByName(kept.drop("_slice", "_rank"))


# Up to here a plain sort-and-limit keeps the merge on one task small.
PLAIN_LIMIT = 10_000
# Cuts per tier of the leading order column, and the accuracy they are found with.
CUTS = 4_096
ACCURACY = 10 * CUTS


def first_rows(
    df: DataFrame, tier: str, lead: str, order: list[str], k: int, plain: int = PLAIN_LIMIT
) -> DataFrame:
    """The first ``k`` rows by ``tier`` and then ``order``, which ``lead`` comes first in.

    A small ``k`` is an ordinary top-k. A large one would bring ``k`` rows of
    every partition to one task, so the rows beyond it are dropped before: the
    size and the cuts of each of the few tiers tell the tier and the value of
    ``lead`` at which the limit falls. That value is only used if a count proves
    that enough rows lie below it; the sort then sees little more than ``k`` rows.

    A large ``k`` reads ``df`` up to three times, so it should be a stored table.
    """
    ordered = [F.col(tier), *map(F.col, order)]
    if k <= plain:
        return df.orderBy(*ordered).limit(max(k, 0))
    shares = F.from_json(F.lit(str([i / CUTS for i in range(1, CUTS)])), "array<double>")
    cuts = F.percentile_approx(lead, shares, ACCURACY)
    tiers = df.groupBy(tier).agg(F.count(F.lit(1)).alias("n"), cuts.alias("cuts")).collect()
    missing = k
    for row in sorted(tiers, key=lambda r: r[tier]):
        if row["n"] > missing:
            break
        missing -= row["n"]
    else:
        return df.orderBy(*ordered)
    before = F.col(tier) < row[tier]
    boundary = F.col(tier) == row[tier]
    place = int((missing / row["n"] + 2 / ACCURACY) * CUTS) + 1
    if row["cuts"] and place <= len(row["cuts"]):
        below = F.col(lead).isNull() | (F.col(lead) <= row["cuts"][place - 1])
        if df.where(boundary & below).count() >= missing:
            boundary = boundary & below
    return df.where(before | boundary).orderBy(*ordered).limit(k)
