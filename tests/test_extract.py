from html.parser import HTMLParser
import re

import pytest

from secretsift.catalog import inputs
from secretsift.operators import extract
from secretsift.sources.captures import normalise_responses

DATA = "/root/testdata/sf0.001"


TRICKY = [
    "<a href='/1'>x</a><A HREF=/2 >y</A><a title=\"href=/no\" href=\"/3\">",
    "<a data-href='/no' href = '/4?a=1&amp;b=2'><a\nhref\n=\n'/5'\n><abbr href='/no'>",
    "<!-- <a href='/no'> --><a href='/6'><script>var a = \"<a href='/no'>\";</script><a href='/7'>",
    "<a href='/8' href='/9'><a href=''><a href><a name=n>",
    "<a title=it's href=/10><a href=\"/11\" title='a > b'><a/href='/12'>",
    "<script src=a.js></script><script SRC='b.js' data-src=\"c.js\">import 'no.js'</script>",
    "<script>import \"d.js\"; require( 'e.js' );\nimport\n'f.js'</script><script src=''>require('no')</script>",
    "<script>importScripts('g.js');loadScript(\"h.js\");require('i.js')</script >",
    "<link href=a.css><iframe src='b.html' data-src='c.html'></iframe><object data=d.swf></object>",
    "<frame src=e.html><embed src=f.swf href=g><linkx href=no><style>a{b:'<link href=no>'}</style>",
    "<!-- open <a href='/13'><p>", "<script>require('j.js')", "<a href=\"/14\nx\">", "", "<a href='/é&eacute;'>",
]


class Parser(HTMLParser):
    """What the operators should find, with the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.anchors, self.scripts, self.embedded, self.imports, self.inline = [], [], [], [], None

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        if tag == "a" and values.get("href"):
            self.anchors.append(values["href"])
        if tag == "script":
            self.scripts += [(a, values[a]) for a in ("src", "data-src") if values.get(a)]
            self.inline = "" if "src" not in values else None
        if tag in extract.RESOURCE_TAGS:
            self.embedded += [
                (tag, a, values[a]) for a in extract.RESOURCE_ATTRIBUTES if values.get(a)
            ]

    handle_startendtag = handle_starttag

    def handle_data(self, data):
        if self.inline is not None and self.cdata_elem == "script":
            self.inline += data

    def handle_endtag(self, tag):
        if tag == "script" and self.inline:
            for name in ("import", "require", "importScripts", "loadScript"):
                call = name + (r"\s+['\"]([^'\"]+)['\"]" if name == "import"
                               else r"\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")
                self.imports += [(name, v) for v in re.findall(call, self.inline)]
            self.inline = None


def parsed(html):
    parser = Parser()
    parser.feed(html)
    parser.close()
    if parser.inline:
        parser.handle_endtag("script")
    return parser


@pytest.fixture(scope="module")
def pages(spark):
    tricky = spark.createDataFrame(
        [(1000 + i, "https://www.example.com/", h) for i, h in enumerate(TRICKY)],
        "page_id long, url string, html string",
    )
    return inputs.pages(spark, DATA).unionByName(tricky)


@pytest.fixture(scope="module")
def expected(pages):
    return {r.page_id: parsed(r.html) for r in pages.collect()}


def compare(found, columns, expected, name):
    got = {}
    for row in found.collect():
        value = tuple(row[c] for c in columns)
        got.setdefault(row.page_id, []).append(value if len(columns) > 1 else value[0])
    want = {p: sorted(getattr(e, name)) for p, e in expected.items() if getattr(e, name)}
    assert {p: sorted(v) for p, v in got.items()} == want


def test_anchors(pages, expected):
    compare(extract.anchors(pages), ["href"], expected, "anchors")


def test_scripts(pages, expected):
    compare(extract.script_sources(pages), ["attribute", "value"], expected, "scripts")


def test_embedded(pages, expected):
    compare(extract.embedded_resources(pages), ["tag", "attribute", "value"], expected, "embedded")


def test_imports(pages, expected):
    compare(extract.inline_imports(pages), ["call", "value"], expected, "imports")


def test_long_tags_do_not_overflow(spark):
    attributes = " ".join(f'a{i}="{i}"' for i in range(50_000))
    script = "x();" * 100_000
    html = f"<a {attributes} href='/end'>t</a><script>{script}require('last.js')</script>"
    pages = spark.createDataFrame([(1, "https://a.com", html)], "page_id long, url string, html string")
    assert [r.href for r in extract.anchors(pages).collect()] == ["/end"]
    assert [r.value for r in extract.inline_imports(pages).collect()] == ["last.js"]


def test_order_within_a_page(spark):
    html = ("<link href=l.css><script>import 'i.js'</script><script data-src=b.js src=a.js></script>"
            "<iframe src=f.html>")
    pages = spark.createDataFrame([(1, "https://a.com/", html)], "page_id long, url string, html string")
    rows = extract.resolved_resources(pages).orderBy("seq").collect()
    assert [r.resource_url for r in rows] == [
        "https://a.com/", "https://a.com/a.js", "https://a.com/b.js", "https://a.com/l.css",
        "https://a.com/f.html", "https://a.com/i.js"]


LINKS = {
    "/a": "https://www.example.com/a", "./a": "https://www.example.com/a",
    " /a&amp;amp;b ": "https://www.example.com/a&b", "a.html": "https://www.example.com/a.html",
    "?q=1": "https://www.example.com/?q=1", "../x": "https://www.example.com/../x",
    "tel:123": "https://www.example.com/tel:123", "//other.com/x": "https://other.com/x",
    "////other.com/x": "https://other.com/x", "https://sub.example.com/p": "https://sub.example.com/p",
    "//example.com/y": "//example.com/y", "example": "example", "https://other.com/x": None, "#top": None,
    "javascript:void(0)": None, "JavaScript:void(0)": "https://www.example.com/JavaScript:void(0)",
    "mailto:x@example.com": "mailto:x@example.com", "/x'.png": None, "https://example.com/x'.png": None,
}


def test_internal_links(spark, mini_rules):
    rows = [(i, "https://www.example.com/start", f'<a href="{h}">') for i, h in enumerate(LINKS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = extract.internal_links(pages, mini_rules).collect()
    assert {r.url for r in found if r.tag_no == 0} == {"https://www.example.com"}
    by_page = {r.page_id: r.url for r in found if r.tag_no > 0}
    assert [by_page.get(i) for i in range(len(LINKS))] == list(LINKS.values())


def test_internal_links_intended(spark, mini_rules):
    links = {"/a": "https://www.example.com/a", "x": "https://www.example.com/d/x", "//other.com/x": None,
             "//sub.example.com/y": "https://sub.example.com/y", "mailto:x@example.com": None, "tel:1": None,
             "JavaScript:void(0)": None, "../x": "https://www.example.com/x", "/p.png": None, "#t": None}
    rows = [(i, "https://www.example.com/d/", f'<a href="{h}">') for i, h in enumerate(links)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = extract.internal_links(pages, mini_rules, "intended").collect()
    by_page = {r.page_id: r.url for r in found if r.tag_no > 0}
    assert [by_page.get(i) for i in range(len(links))] == list(links.values())


def test_json_answers(spark):
    bodies = [r'{"a":"<script src=\"https:\/\/a.com\/x.js\"><\/script>"}', r'{"a":"<script src=b.js>"}',
              '{"a":1} x', "", r'{"a":"\\/ \\u003cscript src=no.js\\u003e"}', "[1, 2]", '"t"']
    rows = [(i, "application/json", b) for i, b in enumerate(bodies)]
    frame = spark.createDataFrame(rows, "page_id long, content_type string, body string")
    shown = normalise_responses(frame).orderBy("page_id").collect()
    assert [r.html.startswith("<html><body>") for r in shown] == [True, True, False, False, True, True, True]
    assert r"src=\"https://a.com/x.js\"></script>" in shown[0].html
    assert "<script src=b.js>" in shown[1].html and "<script" not in shown[4].html
