"""The registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from secretsift.catalog import inputs
from secretsift.functions import urls
from secretsift.functions.text import unescape_html
from secretsift.operators import dedup, detect, extract, ledger, prioritize, report, scope
from secretsift.operators.domains import with_domain_parts
from secretsift.operators.rules import AUTH, CLOUD, DATABASE, GENERIC, INFRA, rules_of
from secretsift.plans import scan
from secretsift.session import INTENDED, REFERENCE, new_work_path
from secretsift.sources import archive, captures, recon, seeds, suffixes
from secretsift.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]

# Limits of the ranking queries: a top-k report, and one large enough for the
# range-based selection when that is forced.
TOP, LARGE_TOP, TOP_PER_HOST = 100, 400, 5
# Limit of a whole scan, beyond the scripts and files that rank high.
SCAN_TOP = 1_500


def _complete() -> Column:
    """Pages cut off on their way count as failed."""
    return F.contains(F.col("html"), F.lit("</html>"))


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    rules = suffixes.builtin_rules(spark)
    return seeds.seed_domains(inputs.seed_lines(spark, folder), rules, INTENDED)


def _links(spark: SparkSession, folder: str, semantics: str = REFERENCE) -> DataFrame:
    rules = suffixes.builtin_rules(spark)
    return extract.internal_links(inputs.pages(spark, folder), rules, semantics)


def _resources(spark: SparkSession, folder: str, semantics: str = REFERENCE) -> DataFrame:
    return scan.resource_scan(
        inputs.pages(spark, folder), _seeds(spark, folder), suffixes.builtin_rules(spark), semantics
    )


def _failed(spark: SparkSession, folder: str) -> DataFrame:
    return captures.failed_urls(inputs.table(spark, folder, "pages"), _complete())


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    unique = dedup.keep_last_origin(_resources(spark, folder))
    return prioritize.rank_resources(dedup.without_failed(unique, _failed(spark, folder)))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("tier", prioritize.tier_name(F.col("tier")))


def seed_domains(semantics: str) -> Query:
    def query(spark, folder):
        rules = suffixes.builtin_rules(spark)
        found = seeds.seed_domains(inputs.seed_lines(spark, folder), rules, semantics)
        return found.groupBy("domain", "label").agg(F.count(F.lit(1)).alias("n"))

    return query


def source(name: str, semantics: str = REFERENCE) -> Query:
    parser = (recon.PARSERS | recon.EXTRA_PARSERS)[name]
    return lambda spark, folder: parser(inputs.all_payloads(spark, folder)[name], semantics)


def archive_rows(semantics: str) -> Query:
    def query(spark, folder):
        answers = inputs.payloads(spark, folder, inputs.ARCHIVE_ROWS)
        return archive.archive_rows(answers.withColumnRenamed("domain", "fqdn"), semantics)

    return query


def archive_captures(semantics: str) -> Query:
    return lambda spark, folder: archive.archive_captures(
        inputs.cdx(spark, folder), inputs.CDX_YEAR, TOP_PER_HOST, semantics
    )


def response_normalise(spark, folder):
    raw = inputs.table(spark, folder, "pages")
    bodies = raw.selectExpr(
        "page_id", "url",
        "explode(array("
        f"struct('text/html' AS content_type, {inputs.PAGE_HTML} AS body), "
        f"struct('Application/JSON; charset=utf-8' AS content_type, {inputs.JSON_BODY} AS body), "
        f"struct('application/json' AS content_type, {inputs.JSON_BODY} || '}}' AS body))) AS answer",
    ).select("page_id", "url", "answer.*")
    shown = captures.normalise_responses(bodies)
    wrapped = F.startswith("html", F.lit("<html><body>{")).alias("wrapped")
    kinds = shown.select(
        "page_id", F.concat_ws(" ", "url", "content_type", wrapped.cast("string")).alias("url"), "html"
    )
    found = extract.script_sources(kinds)
    return found.select(
        "page_id", F.col("url").alias("answer"), urls.clean_url(F.col("value")).alias("script")
    )


def page_status(spark, folder):
    return captures.page_status(inputs.table(spark, folder, "pages"), _complete())


def subdomain_union(spark, folder):
    found = recon.hosts_with_sources(recon.subdomains(inputs.all_payloads(spark, folder)))
    return found.select("fqdn", F.array_join("sources", ",").alias("sources"))


def scan_summary(spark, folder):
    found = recon.subdomains(inputs.all_payloads(spark, folder))
    return recon.scan_summary(found, _seeds(spark, folder))


def host_of_url(spark, folder):
    rows = inputs.table(spark, folder, "pages")
    forms = rows.selectExpr(
        "page_id",
        f"explode(array(url, '//' || {inputs.HOST} || ':8443/x', 'ftp://user:pw@' || {inputs.HOST}, "
        f"{inputs.HOST} || './y?z=@q', 'mailto:me@' || {inputs.HOST}, '/only/path')) AS value",
    )
    return forms.select("page_id", "value", urls.host_of(F.col("value")).alias("host"))


HOST_FORMS = (
    f"{inputs.HOST}", f"'shop.' || {inputs.HOST} || '.co.uk'", f"'me.' || {inputs.DOMAIN} || '.github.io'",
    f"'q.foo.' || {inputs.HOST} || '.ck'", "'z.www.ck'", "'www.ck'", "'github.io'", "'co.uk'",
    "'localhost'", "'192.0.2.7'", f"upper({inputs.HOST})",
)


def registered_domain(spark, folder):
    rows = inputs.table(spark, folder, "pages").selectExpr(
        "page_id", f"explode(array({', '.join(HOST_FORMS)})) AS host"
    )
    return with_domain_parts(
        rows, "host", suffixes.builtin_rules(spark), "registered_domain", "label", "fqdn"
    )


URL_FORMS = (
    "url",
    f"replace(url, '/', {inputs.B} || '/')",
    f"'//cdn.' || {inputs.HOST} || '//x.js'",
    f"'\"' || url || '\"'",
    f"{inputs.Q} || url || {inputs.Q}",
    f"'a' || {inputs.B} || {inputs.B} || 'b' || {inputs.B} || url",
    f"url || '//x?q=' || {inputs.B} || '\"a' || {inputs.B} || '\"'",
    f"replace(url, '://', ':////') || '///y'",
)


def clean_url(semantics: str) -> Query:
    def query(spark, folder):
        rows = inputs.table(spark, folder, "pages").selectExpr(
            "page_id", f"explode(array({', '.join(URL_FORMS)})) AS value"
        )
        return rows.select(
            "page_id", "value", urls.clean_url(F.col("value"), semantics).alias("cleaned")
        )

    return query


LINK_FORMS = (
    "x.js ./x.js /x.js ../x.js ../../../x.js //c.com/x.js ?y=2 #g a/./b/../c.js mailto:q@a.com "
    "data:text/js,1 // b//c/ .. . /a/../../b/./ https://o.com/../k x;p=1?q#r //c.com?z "
    "../..//d x.js?u=../v"
).split() + [""]


def resolve_url(spark, folder):
    links = ", ".join(f"'{link}'" for link in LINK_FORMS)
    rows = inputs.table(spark, folder, "pages").selectExpr(
        "page_id", "url AS base", f"explode(array({links})) AS link"
    )
    return urls.resolve_urls(rows, "base", "link", "resolved")


def unescape_links(spark, folder):
    rows = inputs.table(spark, folder, "pages")
    decoded = unescape_html(F.col("html"))
    return rows.select(
        "page_id", F.md5(decoded.cast("binary")).alias("digest"), F.length(decoded).cast("long").alias("n")
    )


def anchors(spark, folder):
    found = extract.anchors(inputs.pages(spark, folder))
    return found.groupBy("page_id", "url", "href").agg(F.count(F.lit(1)).alias("n"))


def internal_links(semantics: str) -> Query:
    def query(spark, folder):
        found = _links(spark, folder, semantics)
        return found.groupBy("host", "url").agg(
            F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page")
        )

    return query


def byte_filter(semantics: str) -> Query:
    def query(spark, folder):
        return extract.scannable_urls(_links(spark, folder), semantics)

    return query


def pages_of(extractor) -> Query:
    return lambda spark, folder: extractor(inputs.pages(spark, folder))


def network_resources(spark, folder):
    found = _resources(spark, folder)
    return found.select(
        "page_id", "origin_url", "resource_url", extract.via(F.col("part")).alias("via"),
        F.coalesce("seed", F.lit("")).alias("seed"),
    )


def scoped(semantics: str) -> Query:
    def query(spark, folder):
        found = _resources(spark, folder, semantics).where(F.col("seed").isNotNull())
        return found.groupBy("resource_url", "seed").agg(F.count(F.lit(1)).alias("n"))

    return query


def scope_many_seeds(spark, folder):
    """The scope test as it runs with more seeds than a literal list takes."""
    rules = suffixes.builtin_rules(spark)
    found = extract.resolved_resources(inputs.pages(spark, folder))
    owned = scope.in_scope(found, _seeds(spark, folder), rules, REFERENCE, inline=0)
    owned = owned.where(F.col("seed").isNotNull())
    return owned.groupBy("resource_url", "seed").agg(F.count(F.lit(1)).alias("n"))


def _place(df: DataFrame) -> DataFrame:
    return df.select(
        "resource_url", "origin_url", F.col("seq.page_id").alias("first_page"),
        extract.via(F.col("seq.part")).alias("first_via"),
    )


def dedup_last(spark, folder):
    return _place(dedup.keep_last_origin(_resources(spark, folder)))


def dedup_first(spark, folder):
    return _place(dedup.keep_first_origin(_resources(spark, folder)))


def not_failed(spark, folder):
    unique = dedup.keep_last_origin(_resources(spark, folder))
    return _place(dedup.without_failed(unique, _failed(spark, folder)))


def tier_internal(semantics: str) -> Query:
    def query(spark, folder):
        ranked = prioritize.rank_internal(_links(spark, folder), semantics)
        return _named(ranked).select("url", "tier")

    return query


def tier_resource(semantics: str) -> Query:
    def query(spark, folder):
        unique = dedup.keep_first_origin(_resources(spark, folder))
        return _named(prioritize.rank_resources(unique, semantics)).select("resource_url", "tier")

    return query


def tiered_limit(spark, folder):
    chosen = prioritize.select_first(_ranked(spark, folder), TOP)
    return _named(chosen).select("resource_url", "origin_url", "tier")


def tiered_limit_internal(spark, folder):
    chosen = scan.internal_url_scan(
        inputs.pages(spark, folder), suffixes.builtin_rules(spark), TOP
    )
    return _named(chosen).select("url", "tier")


def tiered_limit_ranges(spark, folder):
    """The same selection as it runs for a limit too large for one sort."""
    chosen = prioritize.select_first(_ranked(spark, folder), LARGE_TOP, plain=0)
    return _named(chosen).select("resource_url", "origin_url", "tier")


def priority_distribution(spark, folder):
    found = _resources(spark, folder)
    total = found.agg(F.count(F.lit(1)).alias("n"))
    ranked = prioritize.rank_resources(dedup.keep_last_origin(found))
    return prioritize.priority_distribution(ranked, total, TOP)


def findings(text: str | None, category: str) -> Query:
    def query(spark, folder):
        docs = inputs.table(spark, folder, "documents").selectExpr("doc_id", f"{text or 'text'} AS text")
        return detect.find_credentials(docs, "text", rules_of(category))

    return query


def findings_conversations(spark, folder):
    """All rules over the conversations, which hold no credentials of their own."""
    rows = inputs.table(spark, folder, "conversations").select("conv_id", "turn", "text")
    found = detect.find_credentials(rows, "text")
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def _bodies(spark, folder) -> DataFrame:
    return inputs.captures(spark, folder).select(
        F.lit("https://static.example.com/").alias("base_url"), F.col("url").alias("resource_url"), "body"
    )


def candidates_per_resource(spark, folder):
    listed = detect.candidates_per_text(_bodies(spark, folder), "body")
    wide = report.wide_report(listed)
    return wide.select("base_url", "resource_url", "candidates")


def candidate_rows(spark, folder):
    listed = detect.candidates_per_text(_bodies(spark, folder), "body")
    return detect.one_row_per_candidate(listed, ["base_url", "resource_url", "n_candidates"]).select(
        "base_url", "resource_url", F.col("n_candidates").cast("long").alias("n_candidates"), "fingerprint"
    )


def fingerprint_counts(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "text")
    return detect.fingerprint_counts(detect.find_credentials(docs, "text", rules_of(GENERIC)))


def report_rows(spark, folder):
    found = detect.find_credentials(_bodies(spark, folder), "body")
    return report.report_rows(found, suffixes.builtin_rules(spark))


def report_written(spark, folder):
    """The report after a trip through its CSV files."""
    path = new_work_path(spark, "report")
    report.write_report(report_rows(spark, folder), path)
    return report.read_report(spark, path).drop("scan_date")


def report_wide(spark, folder):
    """The lines of the wide report's files."""
    path = new_work_path(spark, "report")
    listed = detect.candidates_per_text(_bodies(spark, folder), "body")
    report.write_wide(listed, path, suffixes.builtin_rules(spark))
    held = ledger.Ledger(spark, path)
    lines = spark.read.text([f for day in held.days() for f in held.files(day)])
    return lines.where(F.col("value") != ";".join(report.TITLES.values())).select(F.col("value").alias("line"))


def flagship(spark, folder):
    return scan.leak_scan(
        inputs.pages(spark, folder), _seeds(spark, folder), _failed(spark, folder),
        inputs.captures(spark, folder), suffixes.builtin_rules(spark),
    )


def flagship_intended(spark, folder):
    return scan.leak_scan(
        inputs.pages(spark, folder), _seeds(spark, folder), _failed(spark, folder),
        inputs.captures(spark, folder), suffixes.builtin_rules(spark), semantics=INTENDED,
    )


def flagship_limited(spark, folder):
    """The flagship over the first resources of the ranked list only."""
    return scan.leak_scan(
        inputs.pages(spark, folder), _seeds(spark, folder), _failed(spark, folder),
        inputs.captures(spark, folder), suffixes.builtin_rules(spark), limit=SCAN_TOP,
    )


def full_scan(spark, folder):
    """Exports of passive sources to report rows, over the frontier of captured pages."""
    return scan.full_scan(
        scan.host_scan(inputs.all_payloads(spark, folder)), inputs.linked_pages(spark, folder),
        _seeds(spark, folder), _failed(spark, folder), inputs.captures(spark, folder),
        suffixes.builtin_rules(spark),
    )


def frontier_pages(spark, folder):
    """Captured pages that the chained scan goes to, with their place."""
    pages = inputs.linked_pages(spark, folder)
    places = scan.frontier(
        scan.host_scan(inputs.all_payloads(spark, folder)), pages, suffixes.builtin_rules(spark))
    keyed = pages.select("page_id", urls.page_key(urls.clean_url(F.col("url"))).alias("key"))
    return keyed.join(places, "key").select(
        "page_id", "key", prioritize.tier_name(F.col("place.rank")).alias("tier"), F.col("place.start_id").alias("start_id"))


def incremental_scan(spark, folder):
    """A stream over the page files: resources met, each once, with their rank."""
    return incremental.run_incremental(
        spark, f"{folder}/pages*.parquet", new_work_path(spark, "resources"),
        new_work_path(spark, "state"), _seeds(spark, folder), suffixes.builtin_rules(spark),
        prepare=inputs.with_elements,
    ).select("resource_url", "tier")


QUERIES: dict[str, Query] = {
    "q01_seed_domains": seed_domains(REFERENCE),
    "q01_seed_domains_int": seed_domains(INTENDED),
    "q02_ct_names": source("certificates"),
    "q03_pdns_cells": source("passive_dns"),
    "q03_pdns_cells_int": source("passive_dns", INTENDED),
    "q04_domain_report": source("domain_report"),
    "q05_host_table": source("host_table"),
    "q05_host_table_int": source("host_table", INTENDED),
    "q06_json_hosts": source("json_list"),
    "q06_json_hosts_int": source("json_list", INTENDED),
    "q07_archive_rows": archive_rows(REFERENCE),
    "q07_archive_rows_int": archive_rows(INTENDED),
    "q08_archive_filter": archive_captures(REFERENCE),
    "q08_archive_filter_int": archive_captures(INTENDED),
    "q09_response_normalise": response_normalise,
    "q10_page_status": page_status,
    "q11_subdomain_union": subdomain_union,
    "q11_scan_summary": scan_summary,
    "q12_host_of_url": host_of_url,
    "q13_registered_domain": registered_domain,
    "q14_clean_url": clean_url(REFERENCE),
    "q14_clean_url_int": clean_url(INTENDED),
    "q15_resolve_url": resolve_url,
    "q16_unescape_links": unescape_links,
    "q17_anchors": anchors,
    "q17_internal_links": internal_links(REFERENCE),
    "q17_internal_links_int": internal_links(INTENDED),
    "q18_byte_filter_ref": byte_filter(REFERENCE),
    "q18_byte_filter_int": byte_filter(INTENDED),
    "q19_script_sources": pages_of(extract.script_sources),
    "q20_embedded_resources": pages_of(extract.embedded_resources),
    "q21_inline_imports": pages_of(extract.inline_imports),
    "q22_network_resources": network_resources,
    "q23_scope_ref": scoped(REFERENCE),
    "q23_scope_int": scoped(INTENDED),
    "q23_scope_many_seeds": scope_many_seeds,
    "q24_dedup_last": dedup_last,
    "q25_dedup_first": dedup_first,
    "q26_not_failed": not_failed,
    "q27_tier_internal": tier_internal(REFERENCE),
    "q27_tier_internal_int": tier_internal(INTENDED),
    "q28_tier_resource": tier_resource(REFERENCE),
    "q28_tier_resource_int": tier_resource(INTENDED),
    "q29_tiered_limit": tiered_limit,
    "q29_tiered_limit_internal": tiered_limit_internal,
    "q29_tiered_limit_ranges": tiered_limit_ranges,
    "q30_priority_distribution": priority_distribution,
    "q31_findings_generic": findings(None, GENERIC),
    "q32_findings_cloud": findings(inputs.DOC_TEXT["cloud"], CLOUD),
    "q33_findings_database": findings(inputs.DOC_TEXT["database"], DATABASE),
    "q34_findings_auth": findings(inputs.DOC_TEXT["auth"], AUTH),
    "q35_findings_infra": findings(inputs.DOC_TEXT["infrastructure"], INFRA),
    "q35_findings_conversations": findings_conversations,
    "q36_candidates_per_resource": candidates_per_resource,
    "q36_candidate_rows": candidate_rows,
    "q36_fingerprint_counts": fingerprint_counts,
    "q37_report": report_rows,
    "q37_report_written": report_written,
    "q37_report_wide": report_wide,
    "q38_flagship": flagship,
    "q38_flagship_int": flagship_intended,
    "q38_flagship_limited": flagship_limited,
    "q39_incremental_scan": incremental_scan,
    "q40_full_scan": full_scan,
    "q40_frontier": frontier_pages,
}
