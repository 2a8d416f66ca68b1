"""Links, scripts, embedded resources and script imports of a page.

One regular expression walks the page and returns comments, style and script
elements and the wanted start tags in document order, so tags inside comments or
scripts are never taken for real ones. Attributes are read from those pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from secretsift.functions.text import WHITESPACE_CLASS, all_matches, let, once, strip, unescape_html
from secretsift.functions.urls import (
    clean_url,
    ensure_scheme,
    host_of,
    is_byte_content,
    resolve_urls,
)
from secretsift.operators.domains import with_domain_parts
from secretsift.session import INTENDED, REFERENCE, check_semantics
from secretsift.sources.captures import valid_pages
from secretsift.sources.suffixes import SuffixRules

RESOURCE_TAGS = ("link", "iframe", "frame", "embed", "object")
RESOURCE_ATTRIBUTES = ("href", "src", "data", "data-src")
SCRIPT_ATTRIBUTES = ("src", "data-src")

# Parts of a page in the order a scan visits them.
SELF, SCRIPT, EMBEDDED, IMPORT = 0, 1, 2, 3
PART_NAMES = {SELF: "self", SCRIPT: "script", EMBEDDED: "embedded", IMPORT: "import"}

# One attribute, and a run of them. All quantifiers are possessive: no
# backtracking and no deep recursion on long tags.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+"""
_ATTRIBUTES = rf"(?:[\s/]++|{_ATTRIBUTE})*+"

# The calls that load another script, in the order they are looked for.
_SPACE = f"[{WHITESPACE_CLASS}]"
_QUOTED = r"""['"]([^'"]+)['"]"""
IMPORT_CALLS = (
    rf"import{_SPACE}+{_QUOTED}",
    rf"require{_SPACE}*\({_SPACE}*{_QUOTED}{_SPACE}*\)",
    rf"importScripts{_SPACE}*\({_SPACE}*{_QUOTED}{_SPACE}*\)",
    rf"loadScript{_SPACE}*\({_SPACE}*{_QUOTED}{_SPACE}*\)",
)


def _walker(tags: tuple[str, ...]) -> str:
    names = "|".join(t for t in tags if t != "script")
    return (
        r"(?is)<(?:!--.*?-->|!--[^>]*+>"
        rf"|script(?=[\s/>]){_ATTRIBUTES}>.*?(?:</script\s*+>|\z)"
        rf"|style(?=[\s/>]){_ATTRIBUTES}>.*?(?:</style\s*+>|\z)"
        rf"|(?:{names})(?=[\s/>]){_ATTRIBUTES}>)"
    )


def page_tags(pages: DataFrame, tags: tuple[str, ...], with_self: bool = False) -> DataFrame:
    """Start tags (and whole scripts) of each page: ``page_id, url, tag_no, tag, piece``.

    With ``with_self`` every page also gives a first row whose tag is empty.
    """
    pieces = all_matches(F.col("html"), _walker(tags))
    if with_self:
        pieces = F.concat(F.array(F.lit("")), pieces)
    rows = valid_pages(pages).select("page_id", "url", F.posexplode(pieces).alias("tag_no", "piece"))
    rows = rows.withColumn("tag", F.lower(F.regexp_extract("piece", r"^<([A-Za-z]+)", 1)))
    wanted = F.col("tag").isin(*tags)
    if with_self:
        wanted = wanted | (F.col("piece") == "")
    return rows.where(wanted)


def _attributes(piece: Column) -> Column:
    inside = F.regexp_extract(piece, rf"(?is)^<[a-z]+({_ATTRIBUTES})", 1)
    return all_matches(inside, _ATTRIBUTE)


def _values(attributes: Column, name: str) -> Column:
    """Raw occurrences of an attribute."""
    named = F.lit(rf"(?is)^{name}(?:\s*=|\z)")
    return F.filter(attributes, lambda a: F.rlike(a, named))


def _value(attributes: Column, name: str) -> Column:
    """Value of an attribute as written: the last occurrence counts, none gives null."""
    raw = F.regexp_replace(
        F.try_element_at(_values(attributes, name), F.lit(-1)), r"^[^\s/>][^\s/>=]*\s*=?\s*", ""
    )
    quoted = F.rlike(raw, F.lit("^[\"']"))
    bare = F.when(quoted, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return bare


def anchors(pages: DataFrame) -> DataFrame:
    """Non-empty link targets: ``page_id, url, tag_no, href``."""
    rows = page_tags(pages, ("a",)).withColumn("attributes", _attributes(F.col("piece")))
    hrefs = rows.select("page_id", "url", "tag_no", F.explode(_href()).alias("raw"))
    decoded = once(hrefs, href=unescape_html(F.col("raw"))).drop("raw")
    return decoded.where(F.length("href") > 0)


def _href() -> Column:
    """The link target of an anchor as a list of none or one."""
    value = F.array(_value(F.col("attributes"), "href"))
    return F.filter(value, lambda v: F.length(v) > 0)


def script_sources(pages: DataFrame) -> DataFrame:
    """``page_id, url, attribute, value`` of script tags."""
    rows = _candidates(pages, ("script",)).where(F.col("part") == SCRIPT)
    return rows.select("page_id", "url", "attribute", "value")


def embedded_resources(pages: DataFrame) -> DataFrame:
    """``page_id, url, tag, attribute, value`` of link, frame and object tags."""
    rows = _candidates(pages, RESOURCE_TAGS).where(F.col("part") == EMBEDDED)
    return rows.select("page_id", "url", "tag", "attribute", "value")


def inline_imports(pages: DataFrame) -> DataFrame:
    """``page_id, url, call, value`` of loads inside scripts without a source."""
    rows = _candidates(pages, ("script",)).where(F.col("part") == IMPORT)
    return rows.select("page_id", "url", F.col("attribute").alias("call"), "value")


_CALL_NAMES = ("import", "require", "importScripts", "loadScript")


def _candidates(pages: DataFrame, tags: tuple[str, ...], with_self: bool = False) -> DataFrame:
    """Every address a page names, raw, with its place in the page."""
    rows = page_tags(pages, tags, with_self).withColumn("attributes", _attributes(F.col("piece")))
    empty = F.array().cast("array<struct<part:int,attribute:string,value:string>>")

    def item(part: int, attribute: str, value: Column) -> Column:
        return F.struct(
            F.lit(part).alias("part"), F.lit(attribute).alias("attribute"), value.alias("value")
        )

    def attribute_items(part: int, names: tuple[str, ...]) -> Column:
        found = [item(part, n, _value(F.col("attributes"), n)) for n in names]
        return F.filter(F.array(*found), lambda i: F.length(i["value"]) > 0)

    # A script that is never closed has no text for the parser.
    body = F.regexp_extract("piece", rf"(?is)^<script{_ATTRIBUTES}>(.*?)</script\s*+>\z", 1)

    def call_items(name: str, call: str) -> Column:
        return F.transform(all_matches(body, call, 1), lambda v: item(IMPORT, name, v))

    calls = [call_items(name, call) for name, call in zip(_CALL_NAMES, IMPORT_CALLS)]
    inline = F.size(_values(F.col("attributes"), "src")) == 0
    any_call = F.rlike("piece", F.lit("import|require|loadScript"))
    imports = F.when(inline & any_call, F.concat(*calls)).otherwise(empty)
    items = (
        F.when(F.col("piece") == "", F.array(item(SELF, "self", F.col("url"))))
        .when(F.col("tag") == "script", F.concat(attribute_items(SCRIPT, SCRIPT_ATTRIBUTES), imports))
        .otherwise(attribute_items(EMBEDDED, RESOURCE_ATTRIBUTES))
    )
    placed = rows.select("page_id", "url", "tag_no", "tag", F.posexplode(items).alias("item_no", "item"))
    placed = placed.select("page_id", "url", "tag_no", "tag", "item_no", "item.*")
    # Script text is no markup, so imports and the page's own address stay as they are.
    encoded = F.col("part").isin(SCRIPT, EMBEDDED)
    value = F.when(encoded, unescape_html(F.col("value"))).otherwise(F.col("value"))
    return once(placed, value=value).where(F.length("value") > 0)


def resolved_resources(pages: DataFrame, semantics: str = REFERENCE) -> DataFrame:
    """Resource addresses of each page before any scope test.

    ``origin_url, resource_url, page_id, via, seq``; ``seq`` orders them as the
    scan meets them. Attribute values are cleaned, imports are taken as written.
    """
    check_semantics(semantics)
    found = _candidates(pages, ("script", *RESOURCE_TAGS), with_self=True)
    origin = clean_url(F.col("url"), semantics)
    link = (
        F.when(F.col("part") == SELF, F.lit(""))
        .when(F.col("part") == IMPORT, F.col("value"))
        .otherwise(clean_url(F.col("value"), semantics))
    )
    seq = F.struct("page_id", "part", "tag_no", "item_no")
    rows = once(found, origin_url=origin, link=link, seq=seq)
    rows = rows.select("origin_url", "link", "part", "seq")
    rows = resolve_urls(rows, "origin_url", "link", "resource_url")
    byte = is_byte_content(F.col("resource_url"), semantics)
    return rows.where((F.col("part") == SELF) | ~byte).select(
        "origin_url", "resource_url", F.col("seq.page_id").alias("page_id"), "part", "seq"
    )


def via(part: Column) -> Column:
    """Name of a page part."""
    names = F.create_map(*[F.lit(x) for kv in PART_NAMES.items() for x in kv])
    return F.try_element_at(names, part)


def internal_links(
    pages: DataFrame, rules: SuffixRules, semantics: str = REFERENCE
) -> DataFrame:
    """Internal addresses of each page's host: ``host, url, page_id, tag_no``.

    The host's own start address comes first (``tag_no`` 0), then each link made
    absolute. ``intended`` resolves links against the page like a browser and
    keeps those on the page's registered domain.
    """
    tags = page_tags(pages, ("a",), with_self=True)
    tags = tags.withColumn("attributes", _attributes(F.col("piece")))
    links = tags.select(
        "page_id",
        "url",
        "tag_no",
        host_of(F.col("url")).alias("host"),
        F.explode(F.when(F.col("piece") == "", F.array(F.lit(""))).otherwise(_href())).alias("href"),
    )
    # The parser decodes an attribute, and the link rule decodes the link again.
    links = once(links, href=unescape_html(F.col("href")))
    links = once(links, link=unescape_html(strip(F.col("href"))))
    if check_semantics(semantics) == INTENDED:
        rows = _links_on_domain(links, rules)
    else:
        rows = _links_by_prefix(links, rules)
    return rows.select("host", "url", "page_id", "tag_no").where(F.length("url") > 0)


def _start_url() -> Column:
    return F.concat(F.lit("https://"), F.col("host"))


def _links_by_prefix(links: DataFrame, rules: SuffixRules) -> DataFrame:
    """Owned links as they are, others made absolute by how they start."""
    links = once(links, link_host=host_of(F.col("link")))
    links = with_domain_parts(links, "link_host", rules, label="link_label")
    link, root = F.col("link"), _start_url()
    owned = (F.length("link_label") > 0) & F.contains(F.col("host"), F.col("link_label"))
    starts = lambda mark: F.startswith(link, F.lit(mark))
    after = lambda n: F.substring(link, n + 1, 1 << 30)
    outside = starts("https://") | starts("http://") | starts("#")
    absolute = (
        F.when(starts("////") & (F.length(link) > 4), F.concat(F.lit("https://"), after(4)))
        .when(starts("//") & (F.length(link) > 2), F.concat(F.lit("https://"), after(2)))
        .when(starts("/"), F.concat(root, link))
        .when(starts("./"), F.concat(root, after(1)))
        .when(~outside, F.concat(root, F.lit("/"), link))
    )
    url = let(absolute, lambda a: (
        F.when(F.col("tag_no") == 0, root)
        .when(starts("javascript:"), None)
        .when(owned & ~is_byte_content(link), link)
        .when(~is_byte_content(a), a)
    ))
    return once(links, url=url)


def _links_on_domain(links: DataFrame, rules: SuffixRules) -> DataFrame:
    """Links resolved against the page, kept on its registered domain."""
    rows = resolve_urls(links.where(~F.startswith("link", F.lit("#"))), "url", "link", "target")
    rows = once(rows, target_host=host_of(F.col("target")))
    rows = with_domain_parts(rows, "target_host", rules, registered="target_domain")
    rows = with_domain_parts(rows, "host", rules, registered="page_domain")
    owned = (F.col("page_domain") != "") & (F.col("page_domain") == F.col("target_domain"))
    followed = F.rlike("target", F.lit("(?i)^https?://")) & owned
    kept = followed & ~is_byte_content(F.col("target"), INTENDED)
    url = F.when(F.col("tag_no") == 0, _start_url()).when(kept, F.col("target"))
    return once(rows, url=url)


def scannable_urls(links: DataFrame, semantics: str = REFERENCE) -> DataFrame:
    """Distinct internal addresses with a scheme and without binary content."""
    fixed = once(links.select("url"), url=ensure_scheme(F.col("url")))
    return fixed.where(~is_byte_content(F.col("url"), semantics)).distinct()
