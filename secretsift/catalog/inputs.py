"""Inputs of the registered queries, derived from the given tables.

The tables hold plain pages and texts. The expressions below add, to every row
of a table, what the operators look for: scripts, links, exported answers and
secret-looking values built from hashes of the row. They are SQL texts that mean
the same in Spark and in other engines; backslashes and quotes are written as
character codes for that reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


B = "chr(92)"
Q = "chr(39)"
NL = "chr(10)"

HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
DOMAIN = f"regexp_extract({HOST}, '([^.]+[.][^.]+)$', 1)"
COMPLETE = "contains(html, '</html>')"
STATUS = f"CASE WHEN {COMPLETE} THEN 200 ELSE 503 END"


def _text(number: str) -> str:
    return f"CAST({number} AS STRING)"


_N3, _N5, _N7 = (_text(f"page_id % {n}") for n in (3, 5, 7))

PAGE_HTML = " || ".join([
    "html",
    f"'<script src=\"/static/app' || {_N7} || '.js\" defer></script>'",
    f"'<script data-src=\"//cdn.example.org/lib' || {_N5} || '.js\"></script>'",
    *[
        f"'<script src=\"https://static.example.com/js/' || {_text(f'page_id * 4 + {k}')} "
        "|| '.js\"></script>'"
        for k in range(4)
    ],
    f"'<script src=\"https:' || {B} || '/' || {B} || '/blog.example.net' || {B} || '/js' || {B} "
    "|| '/vendor.js\"></script>'",
    f"'<link rel=\"stylesheet\" href=\"../css/site.css?v=' || {_N5} || '&amp;t=1\">'",
    "'<link href=/feed.xml><iframe src=\"https://www.partner.co.uk/embed\"></iframe>'",
    f"'<embed src=\"/media/x' || {Q} || '.png\"><embed src=\"/media/y.png\">'",
    "'<object data=\"/obj/' || substr(md5(url), 1, 8) || '.swf\" data-src=\"./alt.swf\"></object>'",
    "'<!-- <script src=\"/commented.js\"></script><a href=\"/hidden\">h</a> -->'",
    f"'<script>import \"/mod/m' || {_N5} || '.js\"; var q = require(' || {Q} || 'lib' || {_N3} "
    f"|| {Q} || '); importScripts(\"https://cdn.third.io/sw.js\"); "
    "loadScript( \"./late.js\" );</script>'",
    "'<a href=\"https://blog.example.com/x?a=1&amp;b=2\">e</a><a href=\"https://other.co.uk/y\">f</a>'",
    "'<a href=\"//other.co.uk/z\">g</a><a href=\"javascript:void(0)\">j</a>'",
    f"'<a class=\"c\" href=\"rel/' || {_N7} || '.html\">r</a><a href=\"./dot\">d</a>'",
    "'<a href=\"#top\">t</a><a href=\"mailto:x@example.com\">m</a><a href=\" /sp \">s</a>'",
    f"'<a href=\"/pic' || {Q} || '.gif\">p</a><a href=\"/pic.gif\">p</a><a name=\"n\">n</a>'",
])

# Pages that also name themselves, as menus do: the only captured pages that a row knows of.
LINKED_HTML = f"{PAGE_HTML} || '<a href=\"' || regexp_replace(url, '^https?://[^/?#]*', '') || '\">here</a>'"

CERTIFICATES = " || ".join([
    f"'[{{\"name_value\":\"*.' || upper({HOST}) || {B} || 'nadmin@' || {HOST} || {B} || 'nwww.'",
    f"{HOST} || '\"}},{{\"id\":7,\"name_value\":\"mail' || {_N5} || '.' || {HOST} || '\"}}]'",
])
DNS_PAGE = " || ".join([
    f"'<html><table><tr><td>no.' || {HOST} || '</td></tr></table><table class=\"t\" id=\"table\">'",
    f"'<tr><td> ' || {HOST} || ' </td><td>192.0.2.1</td><td>A</td></tr>'",
    f"'<tr><td><a href=\"/s\">API' || {_N5} || '.' || {HOST} || '</a></td></tr></table></html>'",
])
DOMAIN_REPORT = " || ".join([
    f"'{{\"response_code\":\"' || CASE WHEN page_id % 5 = 4 THEN '0' ELSE '1' END",
    f"'\",\"subdomains\":[\"VPN' || {_N7} || '.' || {HOST} || '\",\"' || {HOST}",
    "'\",\"elsewhere.co.uk\"]}'",
])
HOST_TABLE = " || ".join([
    f"'<table><tr><td class=\"col-md-4\">mx' || {_N5} || '.' || {HOST} || '.<br>10 mail</td>'",
    "'<td class=\"col-md-3\">192.0.2.1</td></tr><tr><td class=\"col-md-4\">ns1.elsewhere.uk</td>'",
    f"CASE WHEN page_id % 3 = 0 THEN '<td class=\"col-md-4\"> </td>' ELSE '' END",
    f"'<td class=\"wide col-md-4\">ns' || {_N7} || '.' || {HOST} || '</td></tr></table>'",
])
JSON_HOSTS = f"'<p>[\"a' || {_N5} || '.' || {HOST} || '.\", \"b.' || {HOST} || '\"]</p>'"
ARCHIVE_ROWS = " || ".join([
    f"'[[\"original\"],' || {NL} || '[\"' || url || '\"],' || {NL} || '[\"http://'",
    f"upper({HOST}) || '/a,b' || {_N5} || '\"]]'",
])
JSON_BODY = (
    f"'{{\"c\":\"<script src=' || {B} || '\"https:' || {B} || '/' || {B} || '/' || {HOST} || {B} "
    f"|| '/w' || {_N7} || '.js' || {B} || '\">\"}}'"
)

_MD5 = f"md5({_text('doc_id')})"
DOC_TEXT = {
    "cloud": (
        f"text || ' key AKIA' || upper(substr({_MD5}, 1, 16)) || ' ; short AKIA' "
        f"|| upper(substr({_MD5}, 1, 15)) || ' ; g=AIza' || {_MD5} || 'x_Y ; AccountKey=' "
        f"|| {_MD5} || {_MD5} || substr({_MD5}, 1, 22) || '== ;'"
    ),
    "database": (
        f"text || ' postgres://app:' || substr({_MD5}, 1, 12) || '@db.example.com:5432/x ; "
        f"redis://:' || {_MD5} || '@cache/0 ; mysql://nobody@db/x ; "
        f"jdbc:mysql://db/x?user=a&password=' || substr({_MD5}, 3, 9) || ' ;'"
    ),
    "auth": (
        f"text || ' eyJ' || {_MD5} || '.eyJ' || {_MD5} || '.' || {_MD5} || ' ; Authorization: Bearer ' "
        f"|| {_MD5} || ' ; ghp_' || {_MD5} || 'aB3d ; ghp_' || {_MD5} || ' ; xoxb-' || {_MD5} || ' ;'"
    ),
    "infrastructure": (
        f"text || {NL} || '-----BEGIN ' || CASE WHEN doc_id % 2 = 0 THEN 'RSA ' ELSE '' END "
        f"|| 'PRIVATE KEY-----' || {NL} || 'https://bot:' || substr({_MD5}, 1, 10) "
        "|| '@ci.example.com/x ; https://ci.example.com/y@z'"
    ),
}
ALL_SECRETS = (
    f"text || ' key AKIA' || upper(substr({_MD5}, 1, 16)) || ' ; "
    f"postgres://app:' || substr({_MD5}, 1, 12) || '@db.example.com:5432/x ; ghp_' || {_MD5} || 'aB3d ;'"
)
CAPTURE_URL = f"'https://static.example.com/js/' || {_text('doc_id')} || '.js'"

CDX_KEY = "lower(regexp_replace(url, '[?#].*$', ''))"
CDX_MIME = (
    "CASE page_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/svg+xml' "
    "WHEN 2 THEN 'image/vnd.adobe.photoshop' WHEN 3 THEN NULL ELSE 'text/html' END"
)
CDX_STATUS = "CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 202 ELSE 200 END"
CDX_MICROS = "1664582400000000 + (page_id * 7 + k * 3) * 86400000000"
CDX_YEAR = 2024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """All pages with the added elements."""
    return with_elements(table(spark, folder, "pages"))


def with_elements(raw: DataFrame) -> DataFrame:
    """Pages with scripts, links and resources added to each."""
    return raw.select("page_id", "url", F.expr(PAGE_HTML).alias("html"))


def linked_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All pages with the added elements and a link to themselves."""
    return table(spark, folder, "pages").select("page_id", "url", F.expr(LINKED_HTML).alias("html"))


def payloads(spark: SparkSession, folder: str, body: str) -> DataFrame:
    """One exported answer per page, about the domain of its host."""
    return table(spark, folder, "pages").selectExpr(
        f"{DOMAIN} AS domain", f"{STATUS} AS status", f"{body} AS body"
    )


def all_payloads(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    bodies = {
        "certificates": CERTIFICATES, "passive_dns": DNS_PAGE, "domain_report": DOMAIN_REPORT,
        "host_table": HOST_TABLE, "json_list": JSON_HOSTS,
    }
    return {name: payloads(spark, folder, body) for name, body in bodies.items()}


def seed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A seed file that names every page's host, in the ways users write them."""
    lines = f"array(' ' || upper({HOST}) || ', ', '# ' || {HOST}, 'localhost', '', {HOST} || ':8080')"
    return table(spark, folder, "pages").selectExpr(f"explode({lines}) AS value")


def cdx(spark: SparkSession, folder: str) -> DataFrame:
    """An archive index with three captures of every page."""
    captures = table(spark, folder, "pages").selectExpr(
        "page_id", "url", "explode(array(0, 1, 2)) AS k"
    )
    return captures.selectExpr(
        f"{HOST} AS fqdn", f"{CDX_KEY} AS urlkey", "url || '?k=' || CAST(k AS STRING) AS original",
        f"{CDX_MIME} AS mimetype", f"{CDX_STATUS} AS statuscode",
        f"timestamp_micros({CDX_MICROS}) AS ts",
    )


def captures(spark: SparkSession, folder: str, text: str = ALL_SECRETS) -> DataFrame:
    """Every document as the captured body of a script."""
    return table(spark, folder, "documents").selectExpr(
        f"{CAPTURE_URL} AS url", "200 AS status", "'application/javascript' AS content_type",
        f"{text} AS body",
    )
