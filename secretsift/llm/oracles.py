"""SQL twins of the operators' queries, for DuckDB over the same tables."""

from __future__ import annotations

from secretsift.llm.lines import MIN_CHARS, MIN_DOCS
from secretsift.llm.quality import (
    MAX_HOST_RATE, MAX_REPEAT_PERCENT, MIN_WORDS, PRIOR_LEAST, PRIOR_MOST, WINDOW,
)

_WORD, _SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"

# Rules for ``{docs}`` (row, doc_id, text, source): metrics, host rates, verdicts.
_QUALITY = rf"""
words AS (
  SELECT *, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM {{docs}}),
windows AS (
  SELECT row, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS w
  FROM (SELECT row, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM words WHERE len(ws) >= {WINDOW})),
again AS (
  SELECT row, i, lag(i) OVER (PARTITION BY row ORDER BY i) AS before FROM (
    SELECT row, i, count(*) OVER (PARTITION BY row, w) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT row, sum(CASE WHEN before IS NULL THEN {WINDOW} ELSE least({WINDOW}, i - before) END) AS n FROM again GROUP BY row),
metrics AS (
  SELECT w.row, w.doc_id, w.source, len(ws)::BIGINT AS n_words,
    length(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')))
      - len(list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')))))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM words w LEFT JOIN repeats r USING (row)),
based AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM metrics),
hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM based GROUP BY source),
total AS (
  SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) AS spread FROM hosts),
prior AS (
  SELECT mean, least(greatest(CASE WHEN spread > 1e-12 THEN mean * (1 - mean) / spread - 1 ELSE {PRIOR_MOST} END,
    {PRIOR_LEAST}), {PRIOR_MOST}) AS strength FROM total),
rates AS (
  SELECT source, round((f + mean * strength) / (n + mean * strength + (1 - mean) * strength), 6) AS host_rate FROM hosts, prior),
judged AS (
  SELECT b.*, host_rate, NOT base_failed AND host_rate < {MAX_HOST_RATE} AS kept
  FROM based b JOIN rates r ON b.source IS NOT DISTINCT FROM r.source)"""

OP1 = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, text, source FROM documents),
{_QUALITY.format(docs="docs")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept FROM judged"""

_KEY = r"translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS place, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT doc_id, place, line, {_KEY} AS k FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {MIN_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (
  SELECT doc_id, place, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
g AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)"""

_WINDOW = 20
OP3 = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {_WINDOW - 1}], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {_WINDOW - 2})) AS i FROM words WHERE len(ws) >= {_WINDOW})),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + {_WINDOW})) AS place FROM later),
placed AS (SELECT doc_id, generate_subscripts(ws, 1) AS place, unnest(ws) AS word FROM words),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text
  FROM placed p ANTI JOIN covered c USING (doc_id, place) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)"""


# The given pages have their main text in one article element; its markup is of a few kinds.
OP11 = r"""WITH bodies AS (
  SELECT row_number() OVER () AS n, page_id, url,
    regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages),
split AS (
  SELECT n, page_id, url, string_split(regexp_replace(
    regexp_replace(body, '</?(?:p|h1)>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), chr(10)) AS lines FROM bodies),
numbered AS (SELECT n, page_id, url, generate_subscripts(lines, 1) AS place, unnest(lines) AS line FROM split),
decoded AS (
  SELECT n, page_id, url, place, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(line,
    '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS line
  FROM numbered),
texts AS (
  SELECT n, page_id, url, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (line <> ''), '') AS text
  FROM decoded GROUP BY n, page_id, url)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts"""


ORACLES: dict[str, str] = {
    "op1_host_quality": OP1,
    "op3_substring_dedup": OP3,
    "op9_line_dedup": OP9,
    "op10_warc": OP10,
    "op11_main_text": OP11,
}
