"""Registered domain, domain label and full name of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from secretsift.sources.suffixes import EXCEPTION, PLAIN, PRIVATE, WILDCARD, SuffixRules


def with_domain_parts(
    df: DataFrame,
    host: str,
    rules: SuffixRules,
    registered: str | None = None,
    label: str | None = None,
    fqdn: str | None = None,
) -> DataFrame:
    """Add the asked parts of column ``host`` under the suffix rules.

    Each possible suffix of the host is looked up in the small rule table, one
    broadcast hash join per suffix length, so rows never leave their partition.
    A host without a known suffix has an empty registered domain and full name,
    and its last label (or the whole address) as label.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    depths = range(1, rules.depth + 1)
    table = F.broadcast(rules.table) if rules.small else rules.table
    lowered = F.lower(F.coalesce(F.col(host), F.lit("")))
    labels = F.length(lowered) - F.length(F.replace(lowered, F.lit("."), F.lit(""))) + 1
    step = df.select(*columns, lowered.alias("_suffix_host"), labels.alias("_suffix_n"))
    step = step.withColumns({
        f"_suffix_{d}": F.when(F.col("_suffix_n") >= d, F.substring_index("_suffix_host", ".", -d)) for d in depths
    })
    for d in depths:
        right = table.select(F.col("suffix").alias(f"_suffix_key_{d}"), F.col("flags").alias(f"_suffix_flags_{d}"))
        step = step.join(right, F.col(f"_suffix_{d}") == F.col(f"_suffix_key_{d}"), "left").drop(f"_suffix_key_{d}")

    def has(d: int, flag: int) -> Column:
        return F.coalesce(F.col(f"_suffix_flags_{d}").bitwiseAND(F.lit(flag)) > 0, F.lit(False))

    exception = F.coalesce(*[F.when(has(d, EXCEPTION), F.lit(d - 1)) for d in reversed(depths)])
    longest = F.greatest(
        F.lit(0),
        *[F.when(has(d, PLAIN), F.lit(d)) for d in depths],
        *[F.when(has(d, WILDCARD) & (F.col("_suffix_n") > d), F.lit(d + 1)) for d in depths],
    )
    private = F.lit(False)
    for d in depths:
        private = F.when(F.col("_suffix_len") == d, has(d, PRIVATE)).otherwise(private)
    step = step.withColumn("_suffix_len", F.coalesce(exception, longest))
    known = F.col("_suffix_len") > 0
    complete = known & (F.col("_suffix_n") > F.col("_suffix_len"))
    name = F.coalesce(F.col(host), F.lit(""))
    tail = lambda n: F.expr(f"substring_index(coalesce(`{host}`, ''), '.', -({n}))")
    address = F.rlike("_suffix_host", F.lit(r"^(?:\d{1,3}\.){3}\d{1,3}$|^\[")) & ~known
    parts = {}
    if registered:
        parts[registered] = F.when(complete, tail("_suffix_len + 1")).otherwise("")
    if label:
        parts[label] = (
            F.when(address, name)
            .when(F.col("_suffix_n") > F.col("_suffix_len"), F.substring_index(tail("_suffix_len + 1"), ".", 1))
            .otherwise("")
        )
    if fqdn:
        parts[fqdn] = F.when(complete | (known & private), name).otherwise("")
    taken = [c for c, n in zip(columns, df.columns) if n not in parts]
    return step.select(*taken, *[c.alias(n) for n, c in parts.items()])
