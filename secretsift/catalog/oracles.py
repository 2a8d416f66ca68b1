"""SQL twins of the registered queries, for an engine with RE2 expressions.

They are written on their own: the suffix rules are joined by exploding labels,
repeats are removed with row numbers, ranks are found with EXISTS over the word
lists, and each credential rule is a query of its own.
"""

from __future__ import annotations

from secretsift.catalog import inputs
from secretsift.catalog.queries import (
    HOST_FORMS,
    LARGE_TOP,
    LINK_FORMS,
    SCAN_TOP,
    TOP,
    TOP_PER_HOST,
    URL_FORMS,
)
from secretsift.functions.patterns import HIGH, INTERNAL, MEDIUM, RESOURCE, url_patterns
from secretsift.functions.urls import BYTE_EXTENSIONS
from secretsift.session import INTENDED, REFERENCE
from secretsift.sources.archive import EXCLUDED_MIME_TYPES, YEARS_BACK
from secretsift.sources.suffixes import ICANN_RULES, PRIVATE_RULES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple[str, ...]]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(_text(c) for c in row) + ")" for row in rows)


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes if c)


# --- Pieces -----------------------------------------------------------------

def host(u: str) -> str:
    bare = f"regexp_replace({u}, '^([A-Za-z0-9+.-]+:)?//', '')"
    authority = f"regexp_extract(regexp_extract({bare}, '^([^/?#]*)', 1), '([^@]*)$', 1)"
    return f"rtrim(trim(regexp_extract({authority}, '^([^:]*)', 1)), '.')"


def with_scheme(u: str) -> str:
    return f"CASE WHEN regexp_matches({u}, '^https?://') THEN {u} ELSE 'https://' || {u} END"


def clean(u: str, intended: bool = False) -> str:
    x = f"replace(replace({u}, '\\\"', '\"'), '\\/', '/')"
    if intended:
        x = f"regexp_replace({x}, '\\?.*=\\\\.*', '', 'g')"
    x = f"regexp_replace({x}, '\\\\+', '/', 'g')"
    x = f"regexp_replace({x}, '({'' if intended else '^|'}[^:])/{{2,}}', '\\1/', 'g')"
    return f"trim({x}, '\"''')"


def is_byte(u: str, intended: bool = False) -> str:
    if not intended:
        return f"regexp_matches({u}, '(?i)[\\pL\\pN_/.]''\\.({'|'.join(BYTE_EXTENSIONS)})')"
    endings = "|".join(e for e in BYTE_EXTENSIONS if e != "xml")
    path = f"regexp_extract({with_scheme(u)}, '^https?://[^/?#]*([^?#]*)', 1)"
    return f"regexp_matches({path}, '(?i)\\.({endings})$')"


def unescape(x: str) -> str:
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        x = f"replace({x}, '{name}', '{char}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def suffix_ctes(source: str, column: str) -> str:
    """``psl(h, registered, label, fqdn)`` for the distinct values of a column."""
    rules = []
    for rule in ICANN_RULES + PRIVATE_RULES:
        kind = "*" if rule[0] == "*" else "!" if rule[0] == "!" else "="
        name = rule.removeprefix("*.").removeprefix("!")
        rules.append((name, kind, "p" if rule in PRIVATE_RULES else "i"))
    return f"""
suffix_rules(sfx, kind, part) AS ({_values(rules)}),
psl_hosts AS (SELECT DISTINCT {column} AS h FROM {source} WHERE {column} IS NOT NULL),
psl_labels AS (SELECT h, string_split(h, '.') AS l, len(string_split(h, '.')) AS n FROM psl_hosts),
psl_depths AS (SELECT h, l, n, unnest(generate_series(1, n)) AS d FROM psl_labels),
psl_match AS (
  SELECT h, d, n, kind, part FROM psl_depths
  JOIN suffix_rules ON lower(array_to_string(list_slice(l, n - d + 1, n), '.')) = sfx),
psl_len AS (
  SELECT h, coalesce(max(CASE WHEN kind = '!' THEN d - 1 END),
    max(CASE WHEN kind = '=' THEN d WHEN kind = '*' AND n > d THEN d + 1 END), 0) AS k,
    max(CASE WHEN kind = '=' AND part = 'p' THEN d END) AS private_k
  FROM psl_match GROUP BY h),
psl AS (
  SELECT x.h,
    CASE WHEN k > 0 AND n > k THEN array_to_string(list_slice(l, n - k, n), '.') ELSE '' END AS registered,
    CASE WHEN coalesce(k, 0) = 0 AND regexp_matches(x.h, '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$') THEN x.h
      WHEN n > coalesce(k, 0) THEN l[n - coalesce(k, 0)] ELSE '' END AS label,
    CASE WHEN k > 0 AND (n > k OR private_k = k) THEN x.h ELSE '' END AS fqdn
  FROM psl_labels x LEFT JOIN psl_len y ON x.h = y.h)"""


def resolve_ctes(source: str, out: str) -> str:
    """``out`` adds ``resolved`` to a source with columns ``base`` and ``link``."""
    return f"""
{out}_a AS (SELECT *, lower(regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS ls,
  regexp_extract(base, '^([a-z]+)://', 1) AS bs, regexp_extract(base, '^[a-z]+://([^/?#]*)', 1) AS bn,
  regexp_extract(base, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS bp,
  regexp_extract(base, '^[^?#]*\\?([^#]*)', 1) AS bq FROM {source}),
{out}_b AS (SELECT *, CASE WHEN ls <> '' THEN substr(link, length(ls) + 2) ELSE link END AS lr FROM {out}_a),
{out}_c AS (SELECT *, regexp_extract(lr, '^//([^/?#]*)', 1) AS ln,
  regexp_replace(lr, '^//[^/?#]*', '') AS la FROM {out}_b),
{out}_d AS (SELECT *, regexp_extract(la, '^([^?#]*)', 1) AS lp, regexp_extract(la, '^[^?#]*\\?([^#]*)', 1) AS lq,
  regexp_extract(la, '^[^#]*#(.*)', 1) AS lg FROM {out}_c),
{out}_e AS (SELECT *, CASE WHEN starts_with(lp, '/') THEN lp ELSE
  regexp_replace(CASE WHEN bp = '' THEN '/' ELSE regexp_replace(bp, '[^/]*$', '') END || lp, '/{{2,}}', '/', 'g')
  END AS merged FROM {out}_d),
{out}_f AS (SELECT *, string_split(substr(split_part(merged, ';', 1), 2), '/') AS segs FROM {out}_e),
{out}_g AS (SELECT *, list_reduce(list_prepend('', segs), lambda acc, s: CASE
    WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN s = '.' THEN acc ELSE acc || '/' || s END)
  || CASE WHEN segs[len(segs)] IN ('.', '..') THEN '/' ELSE '' END AS folded FROM {out}_f),
{out} AS (SELECT * EXCLUDE (ls, bs, bn, bp, bq, lr, ln, la, lp, lq, lg, merged, segs, folded), CASE
  WHEN link = '' THEN base
  WHEN ls <> '' AND ls <> bs THEN link
  WHEN ln <> '' THEN bs || '://' || ln || lp || CASE WHEN lq <> '' THEN '?' || lq ELSE '' END
    || CASE WHEN lg <> '' THEN '#' || lg ELSE '' END
  WHEN lp = '' THEN bs || '://' || bn || bp
    || CASE WHEN lq <> '' THEN '?' || lq WHEN bq <> '' THEN '?' || bq ELSE '' END
    || CASE WHEN lg <> '' THEN '#' || lg ELSE '' END
  ELSE bs || '://' || bn || CASE WHEN folded = '' THEN '/' ELSE folded END
    || CASE WHEN contains(merged, ';') THEN ';' || split_part(merged, ';', 2) ELSE '' END
    || CASE WHEN lq <> '' THEN '?' || lq ELSE '' END || CASE WHEN lg <> '' THEN '#' || lg ELSE '' END
  END AS resolved FROM {out}_g)"""


PAGES = f"aug AS (SELECT page_id, url, {inputs.PAGE_HTML} AS html FROM pages)"

TAGS = """
tag_lists AS (SELECT page_id, url, regexp_extract_all(html,
  '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<(?:a|link|iframe|frame|embed|object)\\s[^>]*>') AS l
  FROM aug),
pieces AS (SELECT page_id, url, unnest(l) AS piece, generate_subscripts(l, 1) AS tag_no FROM tag_lists),
tags AS (SELECT *, lower(regexp_extract(piece, '^<([A-Za-z]+)', 1)) AS tag,
  regexp_extract(piece, '^<[^>]*>') AS head FROM pieces)"""


def attribute(name: str) -> str:
    raw = f"regexp_extract(head, '(?i)\\s{name}\\s*=\\s*(\"[^\"]*\"|[^\\s\">]+)', 1)"
    return f"replace(trim({raw}, '\"'), '&amp;', '&')"


def _attributes(tag_test: str, part: int, names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT page_id, url, {part} AS part, tag_no, {i} AS item_no, tag, '{n}' AS attribute, "
        f"{attribute(n)} AS value FROM tags WHERE {tag_test}"
        for i, n in enumerate(names)
    )


_CALLS = {
    "import": "import\\s+['\"]([^'\"]+)['\"]",
    "require": "require\\s*\\(\\s*['\"]([^'\"]+)['\"]\\s*\\)",
    "importScripts": "importScripts\\s*\\(\\s*['\"]([^'\"]+)['\"]\\s*\\)",
    "loadScript": "loadScript\\s*\\(\\s*['\"]([^'\"]+)['\"]\\s*\\)",
}
SCRIPTS = _attributes("tag = 'script'", 1, ("src", "data-src"))
EMBEDDED = _attributes(
    "tag IN ('link', 'iframe', 'frame', 'embed', 'object')", 2, ("href", "src", "data", "data-src")
)
IMPORTS = " UNION ALL ".join(
    f"SELECT page_id, url, 3 AS part, tag_no, {10 + i} AS item_no, tag, '{name}' AS attribute, "
    f"unnest(regexp_extract_all(piece, {_text(regex)}, 1)) AS value "
    f"FROM tags WHERE tag = 'script' AND NOT regexp_matches(head, '(?i)\\ssrc\\s*=')"
    for i, (name, regex) in enumerate(_CALLS.items())
)
SELF = (
    "SELECT page_id, url, 0 AS part, 0 AS tag_no, 0 AS item_no, '' AS tag, 'self' AS attribute, "
    "url AS value FROM aug"
)
SEEDS = f"seed_list AS (SELECT DISTINCT {inputs.DOMAIN} AS domain, " \
        f"split_part({inputs.DOMAIN}, '.', 1) AS label FROM pages)"
FAILED = f"failed AS (SELECT DISTINCT url FROM pages WHERE NOT {inputs.COMPLETE})"


def _resources(semantics: str = REFERENCE) -> str:
    """CTEs up to ``res``: resources in scope, one row per matching seed."""
    intended = semantics == INTENDED
    if intended:
        scope = (
            "SELECT c.*, CASE WHEN part IN (1, 2) THEN s.domain END AS seed FROM checked c "
            "LEFT JOIN psl ON h = res_host LEFT JOIN seed_list s ON s.domain = psl.registered "
            "WHERE part IN (0, 3) OR s.domain IS NOT NULL"
        )
    else:
        scope = (
            "SELECT *, NULL AS seed FROM checked WHERE part IN (0, 3) UNION ALL "
            "SELECT c.*, s.label AS seed FROM checked c JOIN psl ON h = res_host "
            "JOIN seed_list s ON contains(psl.fqdn, s.label) WHERE part IN (1, 2)"
        )
    found = f"found AS ({SELF} UNION ALL {SCRIPTS} UNION ALL {EMBEDDED} UNION ALL {IMPORTS})"
    links = (
        f"links AS (SELECT page_id, part, tag_no, item_no, {clean('url', intended)} AS base, "
        f"CASE WHEN part = 0 THEN '' WHEN part = 3 THEN value ELSE {clean('value', intended)} END AS link "
        "FROM found WHERE value <> '')"
    )
    checked = (
        f"checked AS (SELECT *, resolved AS resource_url, base AS origin_url, {host('resolved')} AS res_host "
        f"FROM reso WHERE part = 0 OR NOT {is_byte('resolved', intended)})"
    )
    numbered = (
        "res AS (SELECT *, dense_rank() OVER (ORDER BY page_id, part, tag_no, item_no) AS seq, "
        "['self', 'script', 'embedded', 'import'][part + 1] AS via FROM scoped)"
    )
    return ",\n".join([
        PAGES, TAGS, SEEDS, found, links, resolve_ctes("links", "reso"), checked,
        suffix_ctes("checked", "res_host"), f"scoped AS ({scope})", numbered,
    ])


def _unique(last: bool = True) -> str:
    pick = "arg_max" if last else "arg_min"
    return (
        f"uniq AS (SELECT resource_url, {pick}(origin_url, seq) AS origin_url, min(seq) AS first_seq, "
        "arg_min(page_id, seq) AS first_page, arg_min(via, seq) AS first_via FROM res GROUP BY 1)"
    )


def _exists(url: str, scope: str, tier: int, semantics: str) -> str:
    patterns = [p.pattern for p in url_patterns(scope, tier, semantics)]
    if semantics == REFERENCE:
        words = ", ".join(f"({_text(p)})" for p in patterns)
        return f"EXISTS (SELECT 1 FROM (VALUES {words}) w(p) WHERE contains(lower({url}), w.p))"
    return f"regexp_matches(lower({url}), {_text('|'.join(f'({p.lower()})' for p in patterns))})"


def tier_resource(url: str, semantics: str = REFERENCE) -> str:
    return (
        f"CASE WHEN {_exists(url, RESOURCE, HIGH, semantics)} THEN 'high' "
        f"WHEN {_exists(url, RESOURCE, MEDIUM, semantics)} THEN 'medium' ELSE 'low' END"
    )


def tier_internal(url: str, semantics: str = REFERENCE) -> str:
    return f"CASE WHEN {_exists(url, INTERNAL, HIGH, semantics)} THEN 'high' ELSE 'low' END"


_ORDER = "CASE tier WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"

ANCHORS = (
    f"anchors AS (SELECT page_id, url AS page_url, {host('url')} AS host, tag_no, {attribute('href')} AS href "
    f"FROM tags WHERE tag = 'a' AND {attribute('href')} <> '')"
)


def _internal(semantics: str = REFERENCE) -> str:
    """CTEs up to ``ilinks(host, url, page_id, tag_no)``."""
    start = (
        f"SELECT {host('url')} AS host, 'https://' || {host('url')} AS url, page_id, 0 AS tag_no FROM aug"
    )
    trimmed = f"trimmed AS (SELECT *, trim(href) AS link, page_url AS base, {host('trim(href)')} AS link_host FROM anchors)"
    if semantics == INTENDED:
        hosts = f"hosts2 AS (SELECT *, {host('resolved')} AS th FROM ires)"
        both = "both_hosts AS (SELECT th AS x FROM hosts2 UNION SELECT host FROM hosts2)"
        kept = (
            "ilinks AS (" + start + " UNION ALL SELECT t.host, t.resolved, t.page_id, t.tag_no FROM hosts2 t "
            "JOIN psl a ON a.h = t.th JOIN psl b ON b.h = t.host WHERE a.registered = b.registered "
            "AND a.registered <> '' AND regexp_matches(t.resolved, '^https?://') "
            f"AND NOT starts_with(t.link, '#') AND NOT {is_byte('t.resolved', True)})"
        )
        return ",\n".join([
            PAGES, TAGS, ANCHORS, trimmed, resolve_ctes("trimmed", "ires"), hosts, both,
            suffix_ctes("both_hosts", "x"), kept,
        ])
    owned = (
        "owned AS (SELECT t.*, psl.label <> '' AND contains(t.host, psl.label) AS own "
        "FROM trimmed t JOIN psl ON psl.h = t.link_host)"
    )
    absolute = (
        "abs AS (SELECT *, CASE WHEN starts_with(link, '////') AND length(link) > 4 THEN 'https://' || substr(link, 5) "
        "WHEN starts_with(link, '//') AND length(link) > 2 THEN 'https://' || substr(link, 3) "
        "WHEN starts_with(link, '/') THEN 'https://' || host || link "
        "WHEN starts_with(link, './') THEN 'https://' || host || substr(link, 2) "
        "WHEN NOT regexp_matches(link, '^(https?://|#)') THEN 'https://' || host || '/' || link END AS a FROM owned)"
    )
    chosen = (
        "ilinks AS (SELECT * FROM (" + start + " UNION ALL SELECT host, CASE WHEN starts_with(link, 'javascript:') THEN NULL "
        f"WHEN own AND NOT {is_byte('link')} THEN link WHEN NOT {is_byte('a')} THEN a END, page_id, tag_no FROM abs) "
        "WHERE url <> '')"
    )
    return ",\n".join([PAGES, TAGS, ANCHORS, trimmed, suffix_ctes("trimmed", "link_host"), owned, absolute, chosen])


def _payload(body: str) -> str:
    return (
        f"payload AS (SELECT * FROM (SELECT {inputs.DOMAIN} AS domain, {inputs.STATUS} AS status, "
        f"{body} AS body FROM pages) WHERE status = 200)"
    )


_SOURCES = {
    "certificates": (
        inputs.CERTIFICATES,
        "SELECT DISTINCT replace(lower(n), '*.', '') AS fqdn, 'certificates' AS source FROM ("
        "SELECT unnest(string_split(json_extract_string(c, '$.name_value'), chr(10))) AS n FROM ("
        "SELECT unnest(CAST(body AS JSON[])) AS c FROM payload)) WHERE NOT contains(n, '@') AND n <> ''",
    ),
    "passive_dns": (
        inputs.DNS_PAGE,
        "SELECT DISTINCT cell AS fqdn, 'passive_dns' AS source FROM (SELECT domain, "
        "trim(regexp_replace(unnest(regexp_extract_all(regexp_extract(body, '(?s)<table[^>]*id=\"table\".*?</table>'), "
        "'(?s)<td>(.*?)</td>', 1)), '<[^>]*>', '', 'g')) AS cell FROM payload) WHERE contains(cell, domain)",
    ),
    "domain_report": (
        inputs.DOMAIN_REPORT,
        "SELECT DISTINCT lower(s) AS fqdn, 'domain_report' AS source FROM (SELECT domain, "
        "unnest(CAST(json_extract(body, '$.subdomains') AS VARCHAR[])) AS s FROM payload "
        "WHERE json_extract_string(body, '$.response_code') = '1') WHERE contains(s, domain)",
    ),
    "host_table": (
        inputs.HOST_TABLE,
        "SELECT DISTINCT rtrim(w, '.') AS fqdn, 'host_table' AS source FROM (SELECT domain, page_end, i, w FROM ("
        "SELECT domain, words, list_position(words, '') AS page_end, unnest(words) AS w, "
        "generate_subscripts(words, 1) AS i FROM (SELECT domain, list_transform(regexp_extract_all(body, "
        "'(?s)<td class=\"[^\"]*col-md-4\">(.*?)</td>', 1), lambda c: "
        "regexp_extract(regexp_replace(c, '<[^>]*>', '', 'g'), '^\\s*(\\S*)', 1)) AS words FROM payload))) "
        "WHERE ({all} OR coalesce(page_end, 0) = 0 OR i < page_end) AND contains(w, domain)",
    ),
    "json_list": (
        inputs.JSON_HOSTS,
        "SELECT DISTINCT rtrim(n, '.') AS fqdn, 'json_list' AS source FROM (SELECT unnest(string_split("
        "regexp_replace(regexp_extract(body, '<p>(.*?)</p>', 1), '[\\[\\]\"]', '', 'g'), ',')) AS n FROM payload) "
        "WHERE n <> ''",
    ),
}


def _source(name: str, **extra: str) -> str:
    body, query = _SOURCES[name]
    query = query.replace("{all}", extra.get("all", "false"))
    return f"WITH {_payload(body)} {query}"


def _all_sources() -> str:
    return "found AS (" + " UNION ALL ".join(f"SELECT * FROM ({_source(n)})" for n in _SOURCES) + ")"


# --- Credentials ------------------------------------------------------------

_LEFT = "(?:^|[^0-9A-Za-z_])"
_RE2_RULES = {
    "assigned_secret": ("generic", "(?i)(password|passwd|secret|api[_-]?key|token)\\s*[:=]\\s*\"([^\"]{8,})\"", 2),
    "assigned_secret_single": (
        "generic", "(?i)(password|passwd|secret|api[_-]?key|token)['\"]?\\s*[:=]\\s*'([^']{8,})'", 2),
    "aws_access_key": ("cloud", _LEFT + "((?:AKIA|ASIA)[0-9A-Z]{16})(?:[^0-9A-Za-z_]|$)", 1),
    "google_api_key": ("cloud", _LEFT + "(AIza[0-9A-Za-z_-]{35})(?:[^0-9A-Za-z_-]|$)", 1),
    "azure_account_key": ("cloud", "AccountKey=([A-Za-z0-9+/]{86}==)", 1),
    "database_url": (
        "database",
        _LEFT + "((?:postgres(?:ql)?|mysql|mongodb(?:\\+srv)?|redis|amqps?)://[^\\s:/@\"'<>]*:[^\\s/@\"'<>]+@[^\\s\"'<>]+)", 1),
    "jdbc_password": ("database", "(jdbc:[a-z]+:[^\\s\"'<>]*[?&;]password=[^\\s\"'&;<>]+)", 1),
    "json_web_token": (
        "auth", _LEFT + "(eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,})", 1),
    "bearer_token": ("auth", "(?i)" + _LEFT + "bearer\\s+([A-Za-z0-9._~+/-]{16,}=*)", 1),
    "github_token": ("auth", _LEFT + "(gh[pousr]_[A-Za-z0-9]{36})(?:[^0-9A-Za-z_]|$)", 1),
    "slack_token": ("auth", _LEFT + "(xox[abprs]-[A-Za-z0-9-]{10,})", 1),
    "private_key": ("infrastructure", "(-----BEGIN (?:RSA )?PRIVATE KEY-----)", 1),
    "url_login": ("infrastructure", "https?://([^\\s:/@\"'<>]+:[^\\s/@\"'<>]+)@[^\\s/\"'<>]", 1),
}


def _hits(source: str, keep: str, category: str | None = None) -> str:
    parts = [
        f"SELECT {keep}, '{name}' AS rule, '{cat}' AS category, "
        f"unnest(regexp_extract_all(text, {_text(regex)}, {group})) AS value FROM {source}"
        for name, (cat, regex, group) in _RE2_RULES.items()
        if category in (None, cat)
    ]
    return "hits AS (" + " UNION ALL ".join(parts) + ")"


_MASKED = "left(value, least(4, length(value) // 4)) || '***' AS masked, sha256(value) AS fingerprint"


def _findings(category: str, text: str = "text") -> str:
    docs = f"docs AS (SELECT doc_id, {text} AS text FROM documents)"
    return _with(docs, _hits("docs", "doc_id", category)) + f" SELECT doc_id, rule, category, {_MASKED} FROM hits"


_BODIES = (
    f"bodies AS (SELECT 'https://static.example.com/' AS base_url, {inputs.CAPTURE_URL} AS resource_url, "
    f"{inputs.ALL_SECRETS} AS text FROM documents)"
)
_BODY_HITS = _hits("bodies", "base_url, resource_url")
_PRINTS = "prints AS (SELECT DISTINCT base_url, resource_url, sha256(value) AS fingerprint FROM hits)"
_REPORT = (
    _with(_BODIES, _BODY_HITS)
    + f" SELECT DISTINCT base_url, resource_url, 'example.com' AS registered_domain, rule, category, {_MASKED} FROM hits"
)


def _flagship(semantics: str, limit: int | None = None, *before: str) -> str:
    """Report rows of the resources in ``res``, or in the last of the CTEs that follow it."""
    chosen = (
        f"chosen AS (SELECT u.origin_url AS base_url, u.resource_url FROM uniq u "
        f"ANTI JOIN failed f ON f.url = u.resource_url "
        f"ORDER BY CASE {tier_resource('u.resource_url', semantics)} WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, "
        f"first_seq{f' LIMIT {limit}' if limit else ''})"
    )
    bodies = (
        f"bodies AS (SELECT base_url, resource_url, text FROM chosen JOIN (SELECT {inputs.CAPTURE_URL} AS cu, "
        f"{inputs.ALL_SECRETS} AS text FROM documents) ON cu = resource_url)"
    )
    unique = _unique().replace("FROM res ", "FROM met ") if before else _unique()
    return (
        _with(_resources(semantics), *before, unique, FAILED, chosen, bodies, _BODY_HITS)
        + f" SELECT DISTINCT base_url, resource_url, regexp_extract({host('base_url')}, '([^.]+[.][^.]+)$', 1) "
        f"AS registered_domain, rule, category, {_MASKED} FROM hits"
    )


def _key(u: str) -> str:
    bare = f"regexp_replace(split_part({u}, '#', 1), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    name = f"regexp_replace(lower(regexp_extract({bare}, '^[^/?]*')), ':(80|443)?$', '')"
    return f"regexp_replace({name} || regexp_replace({bare}, '^[^/?]*', ''), '/+$', '')"


LINKED_PAGES = f"aug AS (SELECT page_id, url, {inputs.LINKED_HTML} AS html FROM pages)"
_PLACES = (
    "places AS (" + _with(
        _internal().replace(PAGES, LINKED_PAGES), _all_sources(),
        f"named AS (SELECT {with_scheme('url')} AS url, page_id, tag_no FROM ilinks "
        "SEMI JOIN (SELECT DISTINCT lower(fqdn) AS known FROM found) ON lower(host) = known)",
        "firsts AS (SELECT url, min(struct_pack(start_id := page_id, link_no := tag_no)) AS first FROM named "
        f"WHERE NOT {is_byte('url')} GROUP BY url)",
        f"tiered AS (SELECT url, first, {tier_internal('url')} AS tier FROM firsts)",
        f"keyed AS (SELECT {_key(clean('url'))} AS key, CASE tier WHEN 'high' THEN 0 ELSE 2 END AS o, first FROM tiered)")
    + " SELECT key, min(struct_pack(o := o, first := first)) AS place FROM keyed GROUP BY key)"
)
_MET = (
    "met AS (SELECT r.* EXCLUDE (seq), dense_rank() OVER (ORDER BY place, page_id, part, tag_no, item_no) AS seq "
    f"FROM res r JOIN places p ON p.key = {_key('r.origin_url')})"
)
_FRONTIER = _with(_PLACES) + (
    f" SELECT page_id, key, CASE place.o WHEN 0 THEN 'high' ELSE 'low' END AS tier, place.first.start_id AS start_id "
    f"FROM (SELECT page_id, {_key(clean('url'))} AS key FROM pages) JOIN places USING (key)"
)


def _unnested(forms: tuple[str, ...], name: str) -> str:
    return f"forms AS (SELECT page_id, url, unnest([{', '.join(forms)}]) AS {name} FROM pages)"


_SEED_LINES = (
    f"lines AS (SELECT unnest([' ' || upper({inputs.HOST}) || ', ', '# ' || {inputs.HOST}, 'localhost', '', "
    f"{inputs.HOST} || ':8080']) AS value FROM pages), "
    "entries AS (SELECT split_part(replace(replace(lower(value), ',', ''), ' ', ''), ':', 1) AS entry FROM lines "
    "WHERE NOT starts_with(value, '#'))"
)
_SEED_HOSTS = _with(_SEED_LINES, suffix_ctes("entries", "entry"))

_CDX = (
    f"cdx AS (SELECT {inputs.HOST} AS fqdn, {inputs.CDX_KEY} AS urlkey, url || '?k=' || k AS original, "
    f"{inputs.CDX_MIME} AS mimetype, {inputs.CDX_STATUS} AS statuscode, make_timestamp({inputs.CDX_MICROS}) AS ts "
    "FROM (SELECT *, unnest([0, 1, 2]) AS k FROM pages))"
)


def _archive_captures(end: str) -> str:
    mime = "^(" + "|".join(EXCLUDED_MIME_TYPES) + ")" + end
    return _with(
        _CDX,
        f"usable AS (SELECT * FROM cdx WHERE statuscode IN (200, 202) AND year(ts) BETWEEN "
        f"{inputs.CDX_YEAR - YEARS_BACK} AND {inputs.CDX_YEAR} AND NOT coalesce(regexp_matches(mimetype, '{mime}'), false))",
        "firsts AS (SELECT *, row_number() OVER (PARTITION BY fqdn, urlkey ORDER BY ts, original) AS c FROM usable)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY fqdn ORDER BY urlkey) AS r FROM firsts WHERE c = 1)",
    ) + f" SELECT fqdn, urlkey, original FROM ranked WHERE r <= {TOP_PER_HOST}"


_ANSWERS = (
    "answers AS (SELECT page_id, url, unnest(["
    f"{{'t': 'text/html', 'body': {inputs.PAGE_HTML}}}, "
    f"{{'t': 'Application/JSON; charset=utf-8', 'body': {inputs.JSON_BODY}}}, "
    f"{{'t': 'application/json', 'body': {inputs.JSON_BODY} || '}}'}}]) AS a FROM pages), "
    "shown AS (SELECT page_id, url, a.t AS t, a.t LIKE 'App%' AS wrapped, CASE WHEN a.t LIKE 'App%' "
    "THEN replace(a.body, '\\/', '/') ELSE a.body END AS html FROM answers), "
    "aug AS (SELECT page_id, concat_ws(' ', url, t, CAST(wrapped AS VARCHAR)) AS url, html FROM shown)"
)
# A script start tag without an end tag counts as well.
_ANSWER_TAGS = TAGS.replace("</script>|", "</script>|<script[^>]*>|", 1)
_ANSWER_SCRIPTS = (
    "SELECT page_id, url AS answer, " + clean("value") + " AS script FROM (SELECT page_id, url, "
    + "regexp_replace(regexp_extract(head, '(?i)\\ssrc\\s*=\\s*(\"[^\"]*\"|[^\\s>]+)', 1), '^\"(.*)\"$', '\\1') AS value "
    + "FROM tags WHERE tag = 'script' UNION ALL SELECT page_id, url, " + attribute("data-src")
    + " FROM tags WHERE tag = 'script') WHERE value <> ''"
)

_PLACE = "SELECT resource_url, origin_url, first_page, first_via FROM uniq"
_SCOPED = "SELECT resource_url, seed, count(*) AS n FROM res WHERE seed IS NOT NULL GROUP BY ALL"
_RANKED = _with(
    _resources(), _unique(), FAILED,
    f"ranked AS (SELECT *, {tier_resource('resource_url')} AS tier FROM uniq u "
    "ANTI JOIN failed f ON f.url = u.resource_url)",
)


def _limited(k: int) -> str:
    return _RANKED + f" SELECT resource_url, origin_url, tier FROM ranked ORDER BY {_ORDER}, first_seq LIMIT {k}"


def _tiers_internal(semantics: str) -> str:
    return _with(_internal()) + (
        f" SELECT url, {tier_internal('url', semantics)} AS tier FROM (SELECT DISTINCT url FROM ilinks)"
    )


def _tiers_resource(semantics: str) -> str:
    return _with(_resources(), _unique(False)) + (
        f" SELECT resource_url, {tier_resource('resource_url', semantics)} AS tier FROM uniq"
    )


def _links(semantics: str) -> str:
    return _with(_internal(semantics)) + (
        " SELECT host, url, count(*) AS n, min(page_id) AS first_page FROM ilinks GROUP BY ALL"
    )


def _scannable(intended: bool) -> str:
    fixed = f"(SELECT {with_scheme('url')} AS url FROM ilinks)"
    return _with(_internal()) + f" SELECT DISTINCT url FROM {fixed} WHERE NOT {is_byte('url', intended)}"


_SHARES = f"""
, counts AS (SELECT t AS tier, (SELECT count(*) FROM tiers x WHERE x.tier = t) AS found,
  CASE t WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS o FROM (VALUES ('high'), ('medium'), ('low')) v(t)),
 used AS (SELECT *, least(found, greatest({TOP} - coalesce(sum(found) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED
  PRECEDING AND 1 PRECEDING), 0), 0)) AS selected FROM counts)
SELECT tier, found, round(found * 100 / (SELECT count(*) FROM res), 1) AS found_pct,
 CAST(selected AS BIGINT) AS selected, round(selected * 100 / (SELECT sum(selected) FROM used), 1) AS selected_pct FROM used"""

ORACLES: dict[str, str] = {
    "q01_seed_domains": _SEED_HOSTS
    + " SELECT registered AS domain, split_part(registered, '.', 1) AS label, count(*) AS n FROM entries "
    "JOIN psl ON h = entry WHERE entry <> '' GROUP BY ALL",
    "q01_seed_domains_int": _SEED_HOSTS
    + " SELECT registered AS domain, split_part(registered, '.', 1) AS label, count(*) AS n FROM "
    "(SELECT DISTINCT registered FROM entries JOIN psl ON h = entry WHERE registered <> '') GROUP BY ALL",
    "q02_ct_names": _source("certificates"),
    "q03_pdns_cells": _source("passive_dns"),
    "q03_pdns_cells_int": "SELECT DISTINCT lower(fqdn) AS fqdn, source FROM (" + _source("passive_dns").replace(
        "contains(cell, domain)", "ends_with('.' || lower(cell), '.' || domain)") + ")",
    "q04_domain_report": _source("domain_report"),
    "q05_host_table": _source("host_table"),
    "q05_host_table_int": _source("host_table", all="true"),
    "q06_json_hosts": _source("json_list"),
    "q06_json_hosts_int": "SELECT DISTINCT trim(fqdn) AS fqdn, source FROM (" + _source("json_list") + ")",
    "q07_archive_rows": _with(_payload(inputs.ARCHIVE_ROWS)) + " SELECT DISTINCT trim(u) AS url FROM (SELECT unnest("
    "list_slice(string_split(replace(lower(regexp_replace(body, '[\\[\\]\"]', '', 'g')), chr(10), ''), ','), 2, len(body) + 2)) "
    "AS u FROM payload) WHERE length(u) > 1",
    "q07_archive_rows_int": _with(_payload(inputs.ARCHIVE_ROWS)) + " SELECT DISTINCT lower(json_extract_string(r, '$[0]')) "
    "AS url FROM (SELECT unnest(list_slice(CAST(body AS JSON[]), 2, len(body) + 2)) AS r FROM payload)",
    "q08_archive_filter": _archive_captures("$"),
    "q08_archive_filter_int": _archive_captures(""),
    "q09_response_normalise": _with(_ANSWERS, _ANSWER_TAGS) + " " + _ANSWER_SCRIPTS,
    "q10_page_status": f"SELECT page_id, url, CASE WHEN {inputs.COMPLETE} THEN 'ok' ELSE 'failed' END AS status FROM pages",
    "q11_subdomain_union": _with(_all_sources())
    + " SELECT fqdn, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM found GROUP BY fqdn",
    "q11_scan_summary": _with(_all_sources(), SEEDS)
    + " SELECT count(DISTINCT fqdn) AS n_fqdns, (SELECT count(*) FROM seed_list) AS n_seeds, "
    "round(count(DISTINCT fqdn) / (SELECT count(*) FROM seed_list), 1) AS avg_per_seed FROM found",
    "q12_host_of_url": _with(_unnested((
        "url", f"'//' || {inputs.HOST} || ':8443/x'", f"'ftp://user:pw@' || {inputs.HOST}",
        f"{inputs.HOST} || './y?z=@q'", f"'mailto:me@' || {inputs.HOST}", "'/only/path'"), "value"))
    + f" SELECT page_id, value, {host('value')} AS host FROM forms",
    "q13_registered_domain": _with(_unnested(HOST_FORMS, "host"), suffix_ctes("forms", "host"))
    + " SELECT page_id, host, registered AS registered_domain, label, fqdn FROM forms JOIN psl ON h = host",
    "q14_clean_url": _with(_unnested(URL_FORMS, "value")) + f" SELECT page_id, value, {clean('value')} AS cleaned FROM forms",
    "q14_clean_url_int": _with(_unnested(URL_FORMS, "value"))
    + f" SELECT page_id, value, {clean('value', True)} AS cleaned FROM forms",
    "q15_resolve_url": _with(
        f"forms AS (SELECT page_id, url AS base, unnest([{', '.join(_text(x) for x in LINK_FORMS)}]) AS link FROM pages)",
        resolve_ctes("forms", "done")) + " SELECT page_id, base, link, resolved FROM done",
    "q16_unescape_links": f"SELECT page_id, md5({unescape('html')}) AS digest, length({unescape('html')}) AS n FROM pages",
    "q17_anchors": _with(PAGES, TAGS, ANCHORS)
    + " SELECT page_id, page_url AS url, href, count(*) AS n FROM anchors GROUP BY ALL",
    "q17_internal_links": _links(REFERENCE),
    "q17_internal_links_int": _links(INTENDED),
    "q18_byte_filter_ref": _scannable(False),
    "q18_byte_filter_int": _scannable(True),
    "q19_script_sources": _with(PAGES, TAGS) + f" SELECT page_id, url, attribute, value FROM ({SCRIPTS}) WHERE value <> ''",
    "q20_embedded_resources": _with(PAGES, TAGS)
    + f" SELECT page_id, url, tag, attribute, value FROM ({EMBEDDED}) WHERE value <> ''",
    "q21_inline_imports": _with(PAGES, TAGS) + f" SELECT page_id, url, attribute AS call, value FROM ({IMPORTS})",
    "q22_network_resources": _with(_resources())
    + " SELECT page_id, origin_url, resource_url, via, coalesce(seed, '') AS seed FROM res",
    "q23_scope_ref": _with(_resources()) + " " + _SCOPED,
    "q23_scope_int": _with(_resources(INTENDED)) + " " + _SCOPED,
    "q23_scope_many_seeds": _with(_resources()) + " " + _SCOPED,
    "q24_dedup_last": _with(_resources(), _unique()) + " " + _PLACE,
    "q25_dedup_first": _with(_resources(), _unique(False)) + " " + _PLACE,
    "q26_not_failed": _with(_resources(), _unique(), FAILED) + " " + _PLACE
    + " u ANTI JOIN failed f ON f.url = u.resource_url",
    "q27_tier_internal": _tiers_internal(REFERENCE),
    "q27_tier_internal_int": _tiers_internal(INTENDED),
    "q28_tier_resource": _tiers_resource(REFERENCE),
    "q28_tier_resource_int": _tiers_resource(INTENDED),
    "q29_tiered_limit": _limited(TOP),
    "q29_tiered_limit_ranges": _limited(LARGE_TOP),
    "q29_tiered_limit_internal": _with(
        _internal(),
        f"fixed AS (SELECT {with_scheme('url')} AS url, row_number() OVER (ORDER BY page_id, tag_no) AS s FROM ilinks)",
        f"firsts AS (SELECT url, min(s) AS s FROM fixed WHERE NOT {is_byte('url')} GROUP BY url)",
        f"ranked AS (SELECT url, s, {tier_internal('url')} AS tier FROM firsts)")
    + f" SELECT url, tier FROM ranked ORDER BY {_ORDER}, s LIMIT {TOP}",
    "q30_priority_distribution": _with(
        _resources(), _unique(), f"tiers AS (SELECT {tier_resource('resource_url')} AS tier FROM uniq)") + _SHARES,
    "q31_findings_generic": _findings("generic"),
    "q32_findings_cloud": _findings("cloud", inputs.DOC_TEXT["cloud"]),
    "q33_findings_database": _findings("database", inputs.DOC_TEXT["database"]),
    "q34_findings_auth": _findings("auth", inputs.DOC_TEXT["auth"]),
    "q35_findings_infra": _findings("infrastructure", inputs.DOC_TEXT["infrastructure"]),
    "q35_findings_conversations": _with(_hits("conversations", "conv_id, turn"))
    + " SELECT rule, count(*) AS n FROM hits GROUP BY rule",
    "q36_candidates_per_resource": _with(_BODIES, _BODY_HITS, _PRINTS)
    + " SELECT base_url, resource_url, string_agg(fingerprint, ';' ORDER BY fingerprint) AS candidates "
    "FROM prints GROUP BY base_url, resource_url",
    "q36_candidate_rows": _with(_BODIES, _BODY_HITS, _PRINTS)
    + " SELECT base_url, resource_url, count(*) OVER (PARTITION BY base_url, resource_url) AS n_candidates, "
    "fingerprint FROM prints",
    "q36_fingerprint_counts": _with("docs AS (SELECT doc_id, text FROM documents)", _hits("docs", "doc_id", "generic"))
    + f" SELECT rule, category, fingerprint, masked, count(*) AS n_findings FROM (SELECT rule, category, {_MASKED} "
    "FROM hits) GROUP BY ALL",
    "q37_report": _REPORT,
    "q37_report_written": f"SELECT base_url, resource_url, registered_domain, fingerprint FROM ({_REPORT})",
    "q37_report_wide": _with(_BODIES, _BODY_HITS, _PRINTS)
    + " SELECT base_url || ';' || resource_url || ';example.com;' || string_agg(fingerprint, ';' ORDER BY fingerprint) AS line "
    "FROM prints GROUP BY base_url, resource_url",
    "q38_flagship": _flagship(REFERENCE),
    "q38_flagship_int": _flagship(INTENDED),
    "q38_flagship_limited": _flagship(REFERENCE, SCAN_TOP),
    "q40_full_scan": _flagship(REFERENCE, None, _PLACES, _MET).replace(PAGES, LINKED_PAGES),
    "q40_frontier": _FRONTIER,
    "q39_incremental_scan": _with(_resources(), "seen AS (SELECT DISTINCT resource_url FROM res)")
    + f" SELECT resource_url, {tier_resource('resource_url')} AS tier FROM seen",
}
