"""Main text of web pages, by deducing the template of each host.

A page is a sequence of tokens: start tags, end tags and texts, each told apart by
the chain of open elements around it. The occurrence vector of a token holds how often
each different page of a host has it. Tokens with equal vectors form an equivalence
class. A class of at least ``MIN_SIZE`` tokens on at least ``MIN_PAGES`` pages and a
``MIN_SHARE`` of the host's is valid if every page holds its tokens in one order, that order again
and again, and if its occurrences nest with those of other classes: of two that
overlap, the one on fewer pages goes (then the smaller one). The valid classes, nested,
are the host's template; what stands between their tokens are its slots.

A slot's place in the template tells what it holds: text inside menus, page headers,
footers, sidebars, notices, adverts, forms, scripts and comments is dropped. Of
the rest, that of articles is the main text; on pages without one, that of main
elements, then of elements named as content, then everything but texts of the
template and blocks that are links only. A text of the template stays in an article
too only if some page of the host has no such text.

Vectors are never held as a whole: pages are hashed with their count, and the hashes
of a token are combined before the shuffle, so a host with a third of all pages is no
hot key. Exact copies of a page count once. Templates are bounded by the length
of pages over ``MIN_SHARE``; they reach pages by a broadcast while they are few, or by a salted join.

Defined results: null and empty pages, and pages without main text, give an empty
text; a null or malformed address is a host of its own; a host with fewer than ``MIN_PAGES``
pages has no template, so its pages are read by their elements alone. Repeated
rows are pages of their own, with equal texts. Broken markup is read leniently: an end tag without its start is
ignored, an unfinished tag at the end is dropped. Texts are read whole. White
space, as Unicode has it, becomes one space inside a block; a line break element is white space.
An empty table gives an empty result. The input's row travels in one struct, so its
names cannot clash.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType, BooleanType, LongType, StringType, StructField, StructType)

from secretsift.llm.common import released, stored, whole

MIN_SIZE, MIN_PAGES, MIN_SHARE = 3, 3, 0.2
# A text that all of so many pages have is no part of an article.
CONSTANT_PAGES = 5
# Bytes of all templates up to which they are broadcast, and copies of each beyond.
BROADCAST_BYTES, SALTS = 32 << 20, 32

START, END, TEXT = 0, 1, 2

_TOKENS = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
    |</(?P<end>[a-z][^\s/>]*)[^>]*>
    |<(?P<start>[a-z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+)>
    |<(?P<loose>[a-z][^\s/>]*)[^>]*>
    |<[a-z/!?][^>]*(?:>|\Z)
    |(?P<text>[^<]+|<)""", re.I | re.S | re.X)
_NAMED = re.compile(
    r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?(?=[\s/]|$)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split())
# Elements that an element of the same group ends, up to the nearest list or table.
_GROUPS = {t: g for g, tags in (("li", "li"), ("dd", "dt dd"), ("tr", "tr"), ("td", "td th"), ("option", "option"))
           for t in tags.split()}
_HOLDERS = frozenset("ul ol dl menu table tbody thead tfoot select".split())

# Elements without main text, whatever they are in or hold.
_NEVER = frozenset(
    "nav footer aside script style noscript template button select option textarea iframe object svg canvas "
    "video audio map dialog menu head title datalist".split())
# Elements and roles without main text, unless an article or main element is in them.
_SELDOM = frozenset("form header".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Words in class and id that name what isn't main text, the first ones in an article's own name too.
_BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted comment comments "
    "reply replies related recommended teaser teasers disqus".split())
_OTHER = _BESIDE | frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside masthead footer cookie "
    "cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social widget widgets toolbar pagination pager respond discussion feedback hidden form search "
    "skip".split())
_HEADS = frozenset("header topbar".split())
_CONTENT = frozenset((
    "content", "main", "main-content", "maincontent", "article", "article-body", "article-content", "articlebody",
    "post", "post-body", "post-content", "entry", "entry-content", "story", "story-body", "page-content"))

NOTHING, NAMED, MAIN, ARTICLE = range(4)


@dataclass
class Page:
    """Tokens of a page in order, and for texts and block ends what is needed to select them."""

    tokens: list[int]
    items: list[tuple | None]  # (token, text, place, in a link) or None where a block ends
    best: int  # the best place that the page has


@dataclass(slots=True)
class _Open:
    tag: str
    path: int
    away: int  # 1: dropped, unless an article is inside; 2: dropped
    place: int
    link: bool


def _attributes(attrs: str) -> tuple[str, frozenset[str], frozenset[str], bool]:
    """The name for the path, words and whole names of class and id, and whether it is dropped by another attribute."""
    label, words, names, away = "", set(), set(), False
    for m in _NAMED.finditer(attrs):
        name, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            label += f"{name[0]}={_DIGITS.sub('0', value)};"
            words.update(w.lower() for w in _WORDS.findall(value))
            names.update(value.lower().split())
        elif name == "role":
            away |= value.lower() in _ROLES
            if value.lower() in ("main", "article"):
                names.add(value.lower())
        elif name == "hidden":
            away = True
        elif name == "aria-hidden":
            away |= value.lower() == "true"
        else:
            away |= re.search(r"display\s*:\s*none", value, re.I) is not None
    return label, frozenset(words), frozenset(names), away


def _opened(tag: str, attrs: str, outer: _Open) -> _Open:
    label, words, names, away = _attributes(attrs) if attrs.strip(" /") else ("", frozenset(), frozenset(), False)
    path = xxhash.xxh64_intdigest(f"{tag} {label}", outer.path)
    inside = outer.place == ARTICLE
    place = outer.place
    if tag == "article":
        level = 2 if words & _BESIDE or away else 0
        place = max(place, ARTICLE)
    elif tag == "main":
        level, place = (2 if away else 0), max(place, MAIN)
    elif tag in ("html", "body"):
        level = 0
    elif tag in _NEVER or words & _BESIDE:
        level = 2
    elif away or words & _OTHER or (tag in _SELDOM and not (inside and tag == "header")) or (words & _HEADS and not inside):
        level = 1
    else:
        level = 0
        if names & _CONTENT:
            place = max(place, MAIN if "main" in names and "role" in attrs.lower() else NAMED)
    kept = outer.away
    if tag in ("article", "main") and kept == 1:
        kept = 0
    level = max(level, kept)
    return _Open(tag, path, level, place if not level else outer.place, outer.link or tag == "a")


def parse(html: str) -> Page:
    """Tokens of a page and its texts with their places."""
    root = _Open("", 0, 0, NOTHING, False)
    stack, held = [root], {}
    tokens, items, best = [], [], NOTHING

    def close(to: int) -> None:
        for e in stack[to:]:
            held[e.tag] -= 1
        del stack[to:]

    for m in _TOKENS.finditer(html):
        kind = m.lastgroup
        top = stack[-1]
        if kind == "text":
            text = m["text"]
            if not text.strip():
                if items and items[-1] is not None:
                    items.append((0, " ", top.place, top.link, top.away))
                continue
            text = entities.unescape(text)
            token = _token(xxhash.xxh64_intdigest(" ".join(text.split()), top.path), TEXT)
            tokens.append(token)
            items.append((token, text, top.place, top.link, top.away))
        elif kind == "raw":
            tokens.append(_token(xxhash.xxh64_intdigest(m["raw"].lower(), top.path), START))
            if m["raw"].lower() not in ("title", "textarea"):
                continue
            items.append(None)
        elif kind in ("attrs", "start", "loose"):
            tag = (m["start"] or m["loose"]).lower()
            inline = tag in _INLINE
            if not inline:
                items.append(None)
                _imply(tag, stack, close)
            element = _opened(tag, m["attrs"] or "", stack[-1])
            tokens.append(_token(element.path, START))
            if not element.away:
                best = max(best, element.place)
            if tag == "br":
                items.append((0, " ", top.place, top.link, top.away))
            if tag not in _VOID:
                stack.append(element)
                held[tag] = held.get(tag, 0) + 1
        elif kind == "end":
            tag = m["end"].lower()
            if tag not in _INLINE:
                items.append(None)
            if held.get(tag):
                at = len(stack) - 1
                while stack[at].tag != tag and not (tag in _INLINE and stack[at].tag not in _INLINE):
                    at -= 1
                if stack[at].tag == tag:
                    tokens.append(_token(stack[at].path, END))
                    close(at)
    return Page(tokens, [i if i is None else i[:4] for i in items if i is None or not i[4]], best)


def _token(value: int, kind: int) -> int:
    """A signed 64-bit token that tells its kind."""
    value = (value & ~3) | kind
    return value - (1 << 64) if value >> 63 else value


def _imply(tag: str, stack: list[_Open], close) -> None:
    """Close what a block element ends by itself: a paragraph, an item or a cell."""
    at = len(stack) - 1
    while at and stack[at].tag in _INLINE:
        at -= 1
    if stack[at].tag == "p":
        close(at)
    group = _GROUPS.get(tag)
    if group:
        at = len(stack) - 1
        while at and stack[at].tag not in _HOLDERS:
            if _GROUPS.get(stack[at].tag) == group:
                close(at)
                return
            at -= 1


def blocks_of(page: Page, template: set[int], constant: set[int]) -> str:
    """Main text of a page: its blocks, joined by a line feed."""
    out, block = [], []

    def done() -> None:
        text = " ".join("".join(t for t, _ in block).split())
        if text and (page.best or not all(link for t, link in block if t.strip())):
            out.append(text)
        block.clear()

    dropped = constant if page.best else template
    for item in page.items:
        if item is None:
            if block:
                done()
        elif item[2] == page.best and item[0] not in dropped:
            block.append((item[1], item[3]))
    done()
    return "\n".join(out)


def host_of(url: Column) -> Column:
    """Host of an address in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(whole(url), r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]*)", 1))


_SEQUENCE = StructType([
    StructField("row_id", LongType()), StructField("host", LongType()), StructField("copy", LongType()),
    StructField("tokens", ArrayType(LongType()))])
_OCCURRENCE = StructType([
    StructField("host", LongType()), StructField("copy", LongType()), StructField("token", LongType()),
    StructField("n", LongType())])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(_SEQUENCE)
    for batch in batches:
        tokens = [parse(h.as_py()).tokens for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(tokens, type=pa.list_(pa.int64()))], schema=schema)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a page has each of its tokens."""
    schema = to_arrow_schema(_OCCURRENCE)
    for batch in batches:
        offsets = batch.column("tokens").offsets.to_numpy()
        tokens = batch.column("tokens").values.to_numpy()
        page = np.repeat(np.arange(len(batch)), np.diff(offsets))
        tokens = tokens[offsets[0] : offsets[-1]]
        order = np.lexsort((tokens, page))
        page, tokens = page[order], tokens[order]
        new = np.append(True, (np.diff(page) != 0) | (np.diff(tokens) != 0))[: len(tokens)]
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(tokens)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("host").take(page[at]), batch.column("copy").take(page[at]), pa.array(tokens[at]),
             pa.array(counts, type=pa.int64())], schema=schema)


def _orders(sequence: list[int], classes: dict[int, int], sizes: dict[int, int]) -> Iterator[tuple[int, int, int, bool]]:
    """Per class on a page: a hash of its order, and whether the page repeats that order; then overlaps.

    An overlap is given as the class and the one it stands across.
    """
    held: dict[int, list[int]] = {}
    for t in sequence:
        c = classes.get(t)
        if c is not None:
            held.setdefault(c, []).append(t)
    first, last = {}, {}
    for c, found in held.items():
        size = sizes[c]
        order = found[:size]
        good = len(set(order)) == size and found == order * (len(found) // size)
        if good:
            first[c], last[c] = order[0], order[-1]
        yield c, xxhash.xxh64_intdigest(repr(order)) >> 1, 0, good
    stack, across = [], set()
    for t in sequence:
        c = classes.get(t)
        if c not in first:
            continue
        if t == first[c]:
            stack.append(c)
        while stack and stack[-1] != c:
            if c not in stack:
                break
            across.add((c, stack.pop()))
        if stack and stack[-1] == c and t == last[c]:
            stack.pop()
    for c, other in across:
        yield c, 0, other, False


_CHECKED = StructType([
    StructField("host", LongType()), StructField("class", LongType()), StructField("order", LongType()),
    StructField("across", LongType()), StructField("good", BooleanType())])


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different findings per batch; most pages of a host give the same."""
    schema = to_arrow_schema(_CHECKED)
    for batch in batches:
        found, known = set(), {}
        hosts, sequences = batch.column("host").to_pylist(), batch.column("tokens")
        members, groups = batch.column("members"), batch.column("groups")
        for i, host in enumerate(hosts):
            if host not in known:
                classes = dict(zip(members[i].as_py(), groups[i].as_py()))
                sizes: dict[int, int] = {}
                for c in classes.values():
                    sizes[c] = sizes.get(c, 0) + 1
                known[host] = classes, sizes
            found.update((host, *x) for x in _orders(sequences[i].as_py(), *known[host]))
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], type=schema.field(k).type) for k in range(len(schema))], schema=schema)


def _few(templates: DataFrame, most: int) -> bool:
    """Whether all templates together take at most ``most`` bytes."""
    tokens = templates.agg(F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("n"), F.count("*").alias("hosts")).first()
    return 40 * tokens.n + 200 * tokens.hosts <= most


def _with_templates(pages: DataFrame, templates: DataFrame, few: bool, how: str) -> DataFrame:
    """Pages and what is known of their hosts.

    Beyond the bound for a broadcast every template has a copy per salt, so the pages of a host are
    spread over tasks.
    """
    if few:
        return pages.join(F.broadcast(templates), "host", how)
    salted = pages.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = templates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), ["host", "_salt"], how).drop("_salt")


def templates_of(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``host``, ``members`` (tokens of its template) and ``constant``, those of them that all pages have once.

    ``pages`` have ``host`` (a hash) and ``html``. Hosts without a valid class have no row.
    """
    hashed = pages.select(F.monotonically_increasing_id().alias("row_id"), "host", F.xxhash64("html").alias("copy"), "html")
    sequences = stored(hashed.mapInArrow(_sequences, _SEQUENCE))
    repeated = stored(sequences.groupBy("host", "copy").agg(
        F.count("*").alias("copies"), F.min("row_id").alias("first")).where("copies > 1"))
    once = sequences.join(repeated, ["host", "copy"], "left").where("first IS NULL OR first = row_id")
    different = once.groupBy("host").agg(F.count("*").alias("pages"))
    vectors = once.select("host", "copy", "tokens").mapInArrow(_occurrences, _OCCURRENCE).groupBy("host", "token").agg(
        F.count("*").alias("on"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("copy", "n")).alias("vector"))
    shared = vectors.where(F.col("on") >= MIN_PAGES).join(different, "host").where(F.col("on") >= MIN_SHARE * F.col("pages"))
    classes = shared.groupBy("host", "pages", "on", "total", "vector").agg(F.collect_list("token").alias("tokens"))
    classes = stored(classes.where(F.size("tokens") >= MIN_SIZE).withColumn(
        "class", F.xxhash64("on", "total", "vector")))

    candidates = classes.select("host", "class", F.explode("tokens").alias("token")).groupBy("host").agg(
        F.collect_list("token").alias("members"), F.collect_list("class").alias("groups"))
    candidates = stored(candidates)
    few = _few(candidates, broadcast_bytes)
    checked = stored(_with_templates(sequences.select("host", "tokens"), candidates, few, "inner").select(
        "host", "tokens", "members", "groups").mapInArrow(_checks, _CHECKED).distinct())
    ordered = checked.where("across = 0").groupBy("host", "class").agg(
        F.bool_and("good").alias("good"), F.count_distinct("order").alias("orders")).where("good AND orders = 1")
    ordered = ordered.select("host", "class").join(classes, ["host", "class"])
    ranked = ordered.select("host", "class", F.struct("on", F.size("tokens").alias("size"), "class").alias("weight"))
    others = ranked.select("host", F.col("class").alias("across"), F.col("weight").alias("other"))
    pairs = checked.where("across <> 0").select("host", "class", "across").join(ranked, ["host", "class"]).join(
        others, ["host", "across"])
    lost = pairs.select("host", F.when(F.col("weight") < F.col("other"), F.col("class")).otherwise(
        F.col("across")).alias("class")).distinct()
    valid = ordered.join(lost, ["host", "class"], "left_anti")
    everywhere = (F.col("on") == F.col("pages")) & (F.col("total") == F.col("pages")) & (F.col("pages") >= CONSTANT_PAGES)
    found = stored(valid.groupBy("host").agg(
        F.flatten(F.collect_list("tokens")).alias("members"),
        F.flatten(F.collect_list(F.when(everywhere, F.col("tokens")))).alias("constant")))
    released(sequences, repeated, classes, candidates, checked)
    return found


def _extractor(schema: pa.Schema):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, tuple[set[int], set[int]]] = {}
            members, constant = batch.column("members"), batch.column("constant")
            texts = []
            for i, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html"))):
                if host not in known:
                    known[host] = set(members[i].as_py() or ()), set(constant[i].as_py() or ())
                texts.append(blocks_of(parse(html.as_py()), *known[host]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, type=pa.string())], schema=schema)

    return extract


def main_texts(df: DataFrame, url: str = "url", html: str = "html", keep_html: bool = True,
               broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``row`` and the main ``text`` of every page of ``df``."""
    row = F.struct("*") if keep_html else F.struct("*").dropFields(html)
    pages = df.select(row.alias("row"), F.xxhash64(host_of(F.col(url))).alias("host"), whole(F.col(html)).alias("html"))
    templates = templates_of(pages.select("host", "html"), broadcast_bytes)
    given = _with_templates(pages, templates, _few(templates, broadcast_bytes), "left")
    out = StructType([given.schema["row"], StructField("text", StringType())])
    return given.select("row", "host", "html", "members", "constant").mapInArrow(_extractor(to_arrow_schema(out)), out)
