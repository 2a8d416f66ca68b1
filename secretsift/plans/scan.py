"""The end-to-end scans: three, and the chain of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from secretsift.functions import urls
from secretsift.functions.text import once
from secretsift.operators import dedup, detect, extract, membership, prioritize, report, scope
from secretsift.operators.rules import RULES, Rule
from secretsift.session import REFERENCE, cut_lineage
from secretsift.sources import recon
from secretsift.sources.suffixes import SuffixRules


def host_scan(payloads: dict[str, DataFrame], semantics: str = REFERENCE) -> DataFrame:
    """Exports of passive sources to a set of host names."""
    return recon.distinct_hosts(recon.subdomains(payloads, semantics))


def internal_url_scan(
    pages: DataFrame,
    rules: SuffixRules,
    limit: int | None = None,
    semantics: str = REFERENCE,
) -> DataFrame:
    """Start pages to ranked internal URLs: ``url, tier, seq``."""
    links = extract.internal_links(pages, rules, semantics)
    fixed = once(links, url=urls.ensure_scheme(F.col("url")))
    kept = fixed.where(~urls.is_byte_content(F.col("url"), semantics))
    return prioritize.select_first(prioritize.rank_internal(kept, semantics), limit)


def resource_scan(
    pages: DataFrame,
    seeds: DataFrame,
    rules: SuffixRules,
    semantics: str = REFERENCE,
    each_seed: bool = True,
) -> DataFrame:
    """Internal pages to all resources in scope, repeats included."""
    resources = extract.resolved_resources(pages, semantics)
    return scope.in_scope(resources, seeds, rules, semantics, each_seed=each_seed)


def select_resources(
    resources: DataFrame,
    failed: DataFrame,
    limit: int | None = None,
    semantics: str = REFERENCE,
    lead: str = "page_id",
) -> DataFrame:
    """Deduplicate, drop failed URLs, rank and, with a limit, cut: ``origin_url, resource_url, tier, seq``."""
    unique = dedup.without_failed(dedup.keep_last_origin(resources), failed)
    ranked = prioritize.rank_resources(unique, semantics)
    return prioritize.select_first(ranked, limit, lead=lead)


def credential_scan(
    selected: DataFrame,
    captures: DataFrame,
    suffixes: SuffixRules,
    rules: tuple[Rule, ...] = RULES,
    limit: int | None = None,
) -> DataFrame:
    """Search the captured bodies of the selected resources; gives report rows.

    Bodies are searched where they are read; only the few findings meet the
    selection, so no body is ever shuffled, whatever the selection's size. Under a ``limit`` the
    addresses of bodies are first tested against those of the selection, and other bodies are
    not searched. The selection is stored then, as the test reads it too.
    """
    chosen = selected.select(F.col("origin_url").alias("base_url"), "resource_url")
    bodies = captures.where(F.col("status") == 200).select(
        F.col("url").alias("resource_url"), "body"
    )
    if limit is not None:
        chosen = cut_lineage(chosen)
        wanted = membership.bit_array(chosen, "resource_url", limit)
        bodies = bodies.where(membership.may_hold(F.col("resource_url"), *wanted))
    found = detect.find_credentials(bodies, "body", rules).join(chosen, "resource_url")
    return report.report_rows(found, suffixes)


def leak_scan(
    pages: DataFrame,
    seeds: DataFrame,
    failed: DataFrame,
    captures: DataFrame,
    suffixes: SuffixRules,
    limit: int | None = None,
    semantics: str = REFERENCE,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """Internal pages to report rows, the whole way; all resources unless there is a ``limit``."""
    resources = resource_scan(pages, seeds, suffixes, semantics, each_seed=False)
    selected = select_resources(resources, failed, limit, semantics)
    return credential_scan(selected, captures, suffixes, rules, limit)


# Hosts and internal addresses that the tests of a chained scan are laid out for; more let more pages through.
FRONTIER = 500_000


def frontier(
    hosts: DataFrame,
    pages: DataFrame,
    rules: SuffixRules,
    limit: int | None = None,
    semantics: str = REFERENCE,
) -> DataFrame:
    """Pages that the scan goes to: ``key`` of each and its first ``place`` in the ranked list.

    The captured pages of the ``hosts`` (column ``fqdn``) name internal addresses; these are ranked, and
    the ``limit`` best are kept. Addresses of one page are one key.
    """
    known = cut_lineage(hosts.select(F.lower("fqdn").alias("host")).distinct())
    wanted = membership.bit_array(known, "host", FRONTIER)
    starts = pages.where(membership.may_hold(F.lower(urls.host_of(F.col("url"))), *wanted))
    links = extract.internal_links(starts, rules, semantics)
    links = links.join(known.withColumnRenamed("host", "_host"), F.lower("host") == F.col("_host"), "left_semi")
    fixed = once(links, url=urls.ensure_scheme(F.col("url")))
    kept = fixed.where(~urls.is_byte_content(F.col("url"), semantics))
    chosen = prioritize.select_first(prioritize.rank_internal(kept, semantics), limit)
    place = F.struct(F.col("tier").alias("rank"), F.col("seq.page_id").alias("start_id"), F.col("seq.tag_no").alias("link_no"))
    keyed = chosen.select(urls.page_key(urls.clean_url(F.col("url"), semantics)).alias("key"), place.alias("place"))
    return cut_lineage(keyed.groupBy("key").agg(F.min("place").alias("place")))


def frontier_resources(
    places: DataFrame,
    pages: DataFrame,
    seeds: DataFrame,
    rules: SuffixRules,
    semantics: str = REFERENCE,
) -> DataFrame:
    """Resources in scope of the captured pages of a frontier, in the order the scan meets them.

    Pages are tested where they are read and their resources, never their text, meet
    the frontier: by a 64-bit hash of the key and by the key.
    """
    def key(url: Column) -> Column:
        return urls.page_key(urls.clean_url(url, semantics))

    hashed = places.select(F.xxhash64("key").alias("_hash"), "key", "place")
    wanted = membership.bit_array(hashed, "_hash", FRONTIER)
    reached = pages.where(membership.may_hold(F.xxhash64(key(F.col("url"))), *wanted))
    found = once(extract.resolved_resources(reached, semantics), _key=key(F.col("origin_url")))
    # A page has many resources; a hash, not the text of the key, sorts and moves them.
    found = found.withColumn("_of", F.xxhash64("_key"))
    met = found.join(hashed, (F.col("_of") == F.col("_hash")) & (F.col("_key") == F.col("key")))
    seq = F.struct("place.rank", "place.start_id", "place.link_no", "seq.page_id", "seq.part", "seq.tag_no", "seq.item_no")
    placed = met.select("origin_url", "resource_url", "page_id", "part", seq.alias("seq"))
    return scope.in_scope(placed, seeds, rules, semantics, each_seed=False)


def full_scan(
    hosts: DataFrame,
    pages: DataFrame,
    seeds: DataFrame,
    failed: DataFrame,
    captures: DataFrame,
    suffixes: SuffixRules,
    internal_limit: int | None = None,
    limit: int | None = None,
    semantics: str = REFERENCE,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """Host names to report rows, the whole way in two hops over the captured pages.

    Hosts lead to their pages, those to internal addresses, the best of these to their own captured
    pages, and those to resources, whose bodies are searched. ``hosts`` has a column ``fqdn``, as
    ``host_scan`` gives it. A page that several addresses name is scanned once, at its first place.
    """
    places = frontier(hosts, pages, suffixes, internal_limit, semantics)
    resources = frontier_resources(places, pages, seeds, suffixes, semantics)
    selected = select_resources(resources, failed, limit, semantics, lead="rank")
    return credential_scan(selected, captures, suffixes, rules, limit)
