"""Main text of pages: given pages against their SQL twin, made ones against texts known beforehand."""

import random

import pytest
from pyspark.sql import functions as F

from secretsift.llm import templates
from secretsift.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, text string, host int, members string, row int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", 1, "m", 2) for i, u, h in rows], SCHEMA)


def texts(spark, rows, **settings):
    return {r.page_id: r.text for r in templates.main_texts(pages(spark, rows), **settings).select("row.page_id", "text").collect()}


def sentence(rng):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(99)) for _ in range(8))


RICH = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a="<article>no</article>";</script></head>
<body class="has-sidebar"><div class="cookie-notice">We use cookies</div><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<aside class=side><p>Popular now</p><article><p>teaser</p></article></aside><form><label>Name <input></label></form>
<div id="page"><article><header><h1>{title}</h1></header><p>A &amp; B&nbsp;&lt;x&gt; {one}<br>
same   block<p>{two} <b>bo</b>ld<!-- c --> end<ul><li>i1<li>i2</ul><div class="ad-box"><p>Buy!</p></div>
<div class='share'>Share</div><script>x()</script><noscript>no</noscript><table><tr><td>c1<td>c2</table>
<section id="comments"><article class="comment"><p>First!</p></article></section><footer>by me</footer></article></div>
<footer>&copy; x</footer></body></html>"""


def test_kinds_of_elements(spark):
    rows = [(1, "http://a.example/1", RICH.format(title="Head", one="one", two="two"))]
    assert texts(spark, rows)[1].split("\n") == [
        "Head", "A & B <x> one same block", "two bold end", "i1", "i2", "c1", "c2"]


def plain(name, ad, main):
    return (f"<html><body><div><span>{name}</span></div><div><i>Top stories of today</i></div><div>{ad}</div>"
            f"<div>{''.join(f'<p>{t}</p>' for t in main)}</div><div><u>All rights are ours</u></div></body></html>")


def test_template_without_named_elements(spark):
    """On pages of bare divisions only what the pages of a host have in common tells the template."""
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(12):
        main = [sentence(rng) for _ in range(rng.randrange(1, 5))]
        rows.append((i, f"https://b.example:8080/{i}", plain("The Daily", "<a href=x>See more</a>", main)))
        want[i] = "\n".join(main)
    rows += [(100 + i, "https://b.example/copy", rows[0][2]) for i in range(3)]
    want |= {100 + i: want[0] for i in range(3)}
    assert texts(spark, rows) == want
    assert texts(spark, rows, broadcast_bytes=0) == want
    found = templates.templates_of(pages(spark, rows).select(
        F.xxhash64(templates.host_of(F.col("url"))).alias("host"), "html")).collect()
    assert len(found) == 1 and set(found[0].constant) <= set(found[0].members)


def test_repeated_text_of_an_article_stays(spark):
    """A passage that many articles share is no template; one that every page holds is."""
    rng = random.Random(2)
    shared = sentence(rng)
    rows = []
    for i in range(10):
        own = f"<p>{sentence(rng)}</p>" + (f"<p>{shared}</p>" if i else "")
        rows.append((i, "http://c.example/" + str(i), f"<body><article><div>Read our paper</div>{own}</article></body>"))
    found = texts(spark, rows)
    assert all(shared in found[i] for i in range(1, 10))
    assert all("Read our paper" not in t for t in found.values())


def test_copies_only(spark):
    """A host whose pages are all copies keeps their text."""
    html = "<body><nav>x</nav><article><h1>One</h1><p>Two three</p></article></body>"
    assert set(texts(spark, [(i, "http://d.example/", html) for i in range(9)]).values()) == {"One\nTwo three"}


def test_classes_are_ordered_and_nested():
    classes = {1: 10, 2: 10, 3: 10, 4: 20, 5: 20, 6: 20}
    sizes = {10: 3, 20: 3}
    good = {c: ok for c, _, across, ok in templates._orders([1, 2, 4, 5, 6, 4, 5, 6, 3], classes, sizes) if not across}
    assert good == {10: True, 20: True}
    assert not any(a for _, _, a, _ in templates._orders([1, 2, 4, 5, 6, 4, 5, 6, 3], classes, sizes))
    assert {c: ok for c, _, a, ok in templates._orders([1, 3, 2, 1, 2, 3], classes, sizes) if not a} == {10: False}
    assert any(a for _, _, a, _ in templates._orders([1, 4, 2, 5, 3, 6], classes, sizes))


def test_awkward_rows(spark, tmp_path):
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    rows = [
        (1, None, None), (2, "", ""), (3, "no address", "just text"), (4, "http://e.example", "<article>"),
        (5, "http://e.example", "<article></article><p>after</p>"), (6, "http://e.example", "<p>a<p>b</b></i> c</p></p><a href='x"),
        (6, "http://e.example", "<p>a<p>b</b></i> c</p></p><a href='x"), (7, "http://e.example", deep),
        (None, "http://e.example", "<main>m</main><div>n</div>"), (9, "http://f.example", "<article><p>" + "w " * 200_000),
        (10, "http://f.example", "1 < 2 &am &amp; &ampx &#x27; <3"), (11, "http://f.example", "<div title=\"a>b\" hidden>h</div>v")]
    pages(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["op11_main_text"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    by = {r.page_id: r.text for r in found}
    assert [by[i] for i in (1, 2, 3, 4, 5, 6, 7, None)] == ["", "", "just text", "", "", "a\nb c", "core", "m"]
    assert by[9] == " ".join(["w"] * 200_000)
    assert by[10] == "1 < 2 &am & &x ' <3" and by[11] == "v"


def test_empty_table(spark):
    assert texts(spark, []) == {}


@pytest.mark.parametrize("url,host", [
    ("HTTP://User@A.Example:80/x", "a.example"), (None, ""), ("x", ""), ("https://b.example?q", "b.example")])
def test_hosts(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(templates.host_of(F.col("u"))).first()[0] == host
