"""Which resources belong to the seed domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from secretsift.functions.text import once
from secretsift.functions.urls import host_of
from secretsift.operators.domains import with_domain_parts
from secretsift.operators.extract import IMPORT, SELF
from secretsift.session import INTENDED, REFERENCE, check_semantics, cut_lineage
from secretsift.sources.suffixes import SuffixRules

# Seeds up to this number are written into the plan as a literal list.
INLINE_SEEDS = 1_000
# Characters of the grams that host names are looked up by.
GRAM = 3


def in_scope(
    resources: DataFrame,
    seeds: DataFrame,
    rules: SuffixRules,
    semantics: str = REFERENCE,
    inline: int = INLINE_SEEDS,
    each_seed: bool = True,
) -> DataFrame:
    """Resources owned by a seed; a page's own row and script imports always stay.

    ``reference`` owns a host that has the seed's label anywhere in its full name
    and gives a row per seed that matches. ``intended`` compares registered
    domains and gives one row. Adds the matched ``seed``, null where none was
    asked. Whoever removes repeats anyway passes ``each_seed=False``: the seeds then
    only filter, without a row per seed and without ``seed``, however many there are.
    """
    free = F.col("part").isin(SELF, IMPORT)
    hosts = once(resources, _host=host_of(F.col("resource_url")))
    if check_semantics(semantics) == INTENDED:
        found = _equal_domains(hosts, seeds, rules, free, inline)
    else:
        found = _containing_labels(hosts, seeds, rules, free, inline, each_seed)
    return found if each_seed else found.drop("seed")


def _listed(seeds: DataFrame, column: str, inline: int) -> list[str] | None:
    """The seeds' values if they are few, fetched with a bound; else ``None``."""
    rows = seeds.select(column).take(inline + 1)
    return None if len(rows) > inline else [r[0] for r in rows]


def _equal_domains(hosts, seeds, rules, free, inline) -> DataFrame:
    named = with_domain_parts(hosts, "_host", rules, registered="_domain")
    domains = seeds.where(F.length("domain") > 0).select("domain").distinct()
    listed = _listed(domains, "domain", inline)
    if listed is not None:
        owned = F.col("_domain").isin(listed) if listed else F.lit(False)
        kept = named.where(free | owned)
        seed = F.when(~free, F.col("_domain"))
        return kept.withColumn("seed", seed).drop("_host", "_domain")
    joined = named.join(
        domains.withColumnRenamed("domain", "seed"),
        F.when(~free, F.col("_domain")) == F.col("seed"),
        "left",
    )
    return joined.where(free | F.col("seed").isNotNull()).drop("_host", "_domain")


def _containing_labels(hosts, seeds, rules, free, inline, each_seed) -> DataFrame:
    named = with_domain_parts(hosts, "_host", rules, fqdn="_fqdn")
    listed = _listed(seeds, "label", inline)
    none = F.array(F.lit(None).cast("string"))
    if listed is not None:
        labels = F.array(*[F.lit(s) for s in listed]).cast("array<string>")
        if not each_seed:
            name = F.col("_fqdn")
            owned = F.exists(labels, lambda s: F.contains(name, s))
            return named.where(free | owned).drop("_host", "_fqdn")
        owners = F.filter(labels, lambda s: F.contains(F.col("_fqdn"), s))
        found = F.explode(F.when(free, none).otherwise(owners))
        return named.withColumn("seed", found).drop("_host", "_fqdn")
    if named.isStreaming:
        if each_seed:
            raise ValueError("a stream is filtered by many seeds, it can't give a row per seed")
        owned = met_labels(named.where(~free), "_fqdn", seeds.select("label").distinct(), "label").drop("label")
        return owned.unionByName(named.where(free)).drop("_host", "_fqdn")
    owners = owners_by_gram(named.where(~free).select("_fqdn").distinct(), "_fqdn", seeds.select("label").distinct(), "label")
    if each_seed:
        # Domains of one label are seeds of their own, each with its row.
        owners = owners.join(seeds.select("label"), "label")
    owners = owners.withColumnRenamed("label", "seed")
    rows, loose = named.where(~free), named.where(free).drop("_host", "_fqdn")
    if each_seed:
        owned = rows.join(owners.select("_fqdn", "seed"), "_fqdn")
        loose = loose.withColumn("seed", F.lit(None).cast("string"))
    else:
        owned = rows.join(owners.select("_fqdn").distinct(), "_fqdn", "left_semi")
    return owned.drop("_host", "_fqdn").unionByName(loose)


def owners_by_gram(names: DataFrame, name: str, labels: DataFrame, label: str) -> DataFrame:
    """Pairs of a name and a label that it contains, through an index of the labels by one gram each.

    A label stands in the index under its gram that the fewest names hold, so a name meets
    only labels whose rarest gram it has, and the pairs are verified. A label with a gram that no name holds
    is in none and has no entry. A name is exploded into its different grams, at most as
    many as it has characters; labels shorter than a gram are looked up by their own length. ``names`` and ``labels``
    are distinct.
    """
    names = cut_lineage(names.select(name))
    held = names.select(F.explode(_grams(F.col(name))).alias("_gram"))
    # Combined on the map side: as many rows as there are different grams.
    return met_labels(names, name, labels, label, held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n")))


def met_labels(rows: DataFrame, name: str, labels: DataFrame, label: str, common: DataFrame | None = None) -> DataFrame:
    """``rows``, once for each label that their ``name`` contains, with it; see ``owners_by_gram``.

    ``common`` tells how many names hold a gram. Without it, as for a stream, whose names aren't known beforehand,
    a gram is as rare as the labels that hold it are few. Rows are moved to the index, never counted or sorted.
    """
    labels = cut_lineage(labels.select(label))
    own = labels.where(F.length(label) >= GRAM).select(label, F.explode(_grams(F.col(label))).alias("_gram"))
    known = own.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n")) if common is None else common
    rated = own.join(known, "_gram", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    index = rated.groupBy(label).agg(F.min(F.struct("_n", "_gram")).alias("_rarest")).where("_rarest._n > 0")
    index = index.select(label, F.col("_rarest._gram").alias("_gram"))
    kept = [*rows.columns, label]
    held = rows.withColumn("_gram", F.explode(_grams(F.col(name))))
    found = held.join(index, "_gram").where(F.contains(F.col(name), F.col(label))).select(kept)
    short = labels.where(F.length(label) < GRAM)
    sizes = sorted(r[0] for r in short.select(F.length(label)).distinct().collect())
    for size in sizes:
        pieces = rows.withColumn("_piece", F.explode(F.array_distinct(_pieces(F.col(name), size))))
        here = short.where(F.length(label) == size)
        found = found.unionByName(pieces.join(here, F.col("_piece") == F.col(label)).select(kept))
    return found


def _grams(text: Column) -> Column:
    """Different grams of a text; none of a shorter one."""
    return F.when(F.length(text) >= GRAM, F.array_distinct(_pieces(text, GRAM))).otherwise(
        F.array().cast("array<string>"))


def _pieces(name: Column, size: int) -> Column:
    """Every piece of ``size`` characters of a name; a shorter name gives itself."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(name) - size + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substr(name, i, F.lit(size)))
