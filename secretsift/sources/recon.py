"""Host names from exported answers of passive sources.

Every parser takes a table ``(domain, status, body)``, one answer per row, and
returns ``(fqdn, source)`` without repeats. ``PARSERS`` names them; a new source
is one more entry.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from secretsift import schemas
from secretsift.functions.text import WHITESPACE_CLASS, all_matches, once, strip, strip_tags
from secretsift.functions.urls import normalise_subdomain, strip_list_marks
from secretsift.session import INTENDED, REFERENCE, check_semantics

_TABLE = r"""(?is)<table(?=[\s>])[^>]*?\sid\s*=\s*["']?table["']?[\s>].*?</table>"""
_CELL = r"(?is)<td(?:\s[^>]*)?>(.*?)(?=</td\s*>|<td[\s>]|</tr|\z)"
_HOST_CELL = (
    r"""(?is)<td\s(?:[^>]*?\s)?class\s*=\s*(?:"(?:[^">]*\s)?col-md-4(?:\s[^">]*)?"|"""
    r"""'(?:[^'>]*\s)?col-md-4(?:\s[^'>]*)?'|col-md-4)[^>]*>(.*?)</td\s*>"""
)


def _answers(payloads: DataFrame) -> DataFrame:
    return payloads.where(F.col("status") == 200)


def _hosts(df: DataFrame, hosts: Column, source: str) -> DataFrame:
    """Explode an array of names next to its seed domain."""
    return df.select("domain", F.explode(hosts).alias("fqdn"), F.lit(source).alias("source"))


def _result(df: DataFrame) -> DataFrame:
    return df.where(F.length("fqdn") > 0).select("fqdn", "source").distinct()


def certificate_names(payloads: DataFrame, semantics: str = REFERENCE) -> DataFrame:
    """Names of a certificate-log answer: a JSON array with ``name_value`` lists.

    Entries with ``@`` are mail addresses. In ``reference`` one certificate
    without names voids its whole answer; ``intended`` only skips it.
    """
    certificates = F.from_json("body", schemas.CERTIFICATES)
    parsed = _answers(payloads).select("domain", certificates.alias("certificates"))
    if check_semantics(semantics) == REFERENCE:
        complete = F.forall("certificates", lambda c: c["name_value"].isNotNull())
        parsed = parsed.where(complete)
    lists = parsed.select("domain", F.explode("certificates.name_value").alias("names"))
    names = _hosts(lists, F.split("names", "\n"), "certificates")
    names = names.where(~F.contains("fqdn", F.lit("@")))
    return _result(names.withColumn("fqdn", normalise_subdomain(F.col("fqdn"))))


def dns_table_cells(payloads: DataFrame, semantics: str = REFERENCE) -> DataFrame:
    """Cells of the result table of a passive-DNS page that contain the domain.

    ``intended`` lower-cases names and wants the domain as their end.
    """
    intended = check_semantics(semantics) == INTENDED
    table = F.regexp_extract("body", _TABLE, 0)
    cells = _hosts(_answers(payloads), all_matches(table, _CELL, 1), "passive_dns")
    cells = cells.withColumn("fqdn", strip(strip_tags(F.col("fqdn"))))
    if intended:
        cells = cells.withColumn("fqdn", F.lower("fqdn"))
        return _result(cells.where(_below("fqdn", "domain")))
    return _result(cells.where(F.contains("fqdn", F.col("domain"))))


def domain_report(payloads: DataFrame, semantics: str = REFERENCE) -> DataFrame:
    """Sub-domains of a domain report whose response code is the text ``1``."""
    report = F.from_json("body", schemas.DOMAIN_REPORT)
    parsed = _answers(payloads).select("domain", "body", report.alias("report"))
    as_text = F.rlike("body", F.lit(r'"response_code"\s*:\s*"1"'))
    parsed = parsed.where((F.col("report.response_code") == "1") & as_text)
    names = _hosts(parsed, F.col("report.subdomains"), "domain_report")
    if check_semantics(semantics) == INTENDED:
        names = names.withColumn("fqdn", F.lower("fqdn")).where(_below("fqdn", "domain"))
    else:
        names = names.where(F.contains("fqdn", F.col("domain")))
    return _result(names.withColumn("fqdn", F.lower("fqdn")))


def host_table(payloads: DataFrame, semantics: str = REFERENCE) -> DataFrame:
    """First word of each host cell of a DNS host table, if it contains the domain.

    In ``reference`` an empty cell ends the answer; ``intended`` skips it.
    """
    first_word = rf"^[{WHITESPACE_CLASS}]*([^{WHITESPACE_CLASS}]*)"
    words = F.transform(
        all_matches(F.col("body"), _HOST_CELL, 1),
        lambda cell: F.regexp_extract(strip_tags(cell), first_word, 1),
    )
    parsed = once(_answers(payloads).select("domain", "body"), words=words)
    if check_semantics(semantics) == REFERENCE:
        end = F.array_position("words", F.lit(""))
        used = F.when(end > 0, F.slice("words", F.lit(1), (end - 1).cast("int")))
        names = _hosts(parsed, used.otherwise(F.col("words")), "host_table")
    else:
        names = _hosts(parsed, F.col("words"), "host_table")
    names = names.withColumn("fqdn", F.rtrim("fqdn", F.lit(".")))
    return _result(names.where(F.contains("fqdn", F.col("domain"))))


def json_hosts(payloads: DataFrame, semantics: str = REFERENCE) -> DataFrame:
    """Names of a JSON list shown in the first paragraph of a page, or sent bare.

    ``reference`` cuts the text at commas and keeps blanks; ``intended`` parses
    the list and trims the names.
    """
    shown = F.regexp_extract("body", r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</p\s*>|\z)", 1)
    bare = F.when(F.startswith("body", F.lit("<")), F.lit("")).otherwise(
        F.regexp_extract("body", r"(?s)^([^<]*)", 1)
    )
    text = strip_tags(F.when(shown != "", shown).otherwise(bare))
    answers = _answers(payloads).select("domain", text.alias("text"))
    if check_semantics(semantics) == INTENDED:
        items = F.from_json("text", "array<string>")
    else:
        items = F.split(strip_list_marks(F.col("text")), ",")
    names = _hosts(answers, items, "json_list")
    if semantics == INTENDED:
        names = names.withColumn("fqdn", F.lower(strip(F.col("fqdn"))))
    return _result(names.withColumn("fqdn", F.rtrim("fqdn", F.lit("."))))


def _below(fqdn: str, domain: str) -> Column:
    """True if the name is the domain or a sub-domain of it."""
    dotted = F.concat(F.lit("."), F.col(fqdn))
    return F.endswith(dotted, F.concat(F.lit("."), F.col(domain)))


Parser = Callable[..., DataFrame]

# The sources a scan reads by default, and two more that can be asked for.
PARSERS: dict[str, Parser] = {
    "certificates": certificate_names,
    "passive_dns": dns_table_cells,
    "domain_report": domain_report,
}
EXTRA_PARSERS: dict[str, Parser] = {"host_table": host_table, "json_list": json_hosts}


def subdomains(
    payloads: dict[str, DataFrame],
    semantics: str = REFERENCE,
    parsers: dict[str, Parser] | None = None,
) -> DataFrame:
    """Parse every export with its parser: ``(fqdn, source)``."""
    chosen = parsers or (PARSERS | EXTRA_PARSERS)
    parts = [chosen[name](table, semantics) for name, table in payloads.items()]
    return reduce(DataFrame.unionByName, parts)


def distinct_hosts(found: DataFrame) -> DataFrame:
    """The union of all sources as a set of names."""
    return found.select("fqdn").distinct()


def hosts_with_sources(found: DataFrame) -> DataFrame:
    """Each name with the sources that know it; sources are few, so are the lists."""
    return found.groupBy("fqdn").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def scan_summary(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """Number of names, of seeds, and names per seed."""
    names = found.select("fqdn").distinct().agg(F.count(F.lit(1)).alias("n_fqdns"))
    n_seeds = seeds.agg(F.count(F.lit(1)).alias("n_seeds"))
    per_seed = F.round(F.try_divide(F.col("n_fqdns"), F.col("n_seeds")), 1)
    return names.select("n_fqdns", n_seeds.scalar().alias("n_seeds")).withColumn(
        "avg_per_seed", per_seed
    )
