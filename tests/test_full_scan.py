"""The chained scan and the limited one: what they reach, what they leave, and their plans."""

import re

import pytest
from pyspark.sql import functions as F

from secretsift import schemas
from secretsift.catalog import inputs, queries
from secretsift.functions import urls
from secretsift.operators import membership
from secretsift.plans import scan
from secretsift.sources import suffixes

DATA = "/root/testdata/sf0.001"
KEY = "AKIA" + "ABCD" * 4


@pytest.mark.parametrize("url,key", [
    ("https://A.Example.com:443/x/?q=1#f", "a.example.com/x/?q=1"), ("http://a.example.com/", "a.example.com"),
    ("HTTP://a.example.com:80", "a.example.com"), ("a.example.com/B//", "a.example.com/B"), ("", ""), (None, None),
    ("https://a.example.com:8080/p", "a.example.com:8080/p"), ("https://a.example.com?u=http://b", "a.example.com?u=http://b")])
def test_page_key(apply, url, key):
    assert apply(urls.page_key, [url]) == [key]


def test_members_always_pass(spark):
    values = spark.range(3000).select(F.concat(F.lit("v"), "id").alias("v"))
    wanted = membership.bit_array(values, "v", 3000)
    assert values.where(membership.may_hold(F.col("v"), *wanted)).count() == 3000
    others = spark.range(20_000).select(F.concat(F.lit("w"), "id").alias("v"))
    assert others.where(membership.may_hold(F.col("v"), *wanted)).count() < 600


def test_full_array_lets_all_pass(spark):
    """More values than the array is laid out for cost time, not rows; an empty set holds nothing."""
    assert membership.bits_for(1 << 40) == membership.MOST_BITS
    none = spark.range(0).select(F.col("id").cast("string").alias("v"))
    wanted = membership.bit_array(none, "v", 10)
    assert spark.range(50).where(membership.may_hold(F.col("id").cast("string"), *wanted)).count() == 0


def made(spark):
    """Three hosts; one of them unknown, one page of the others that no address names."""
    def page(i, url, links, script):
        tags = "".join(f'<a href="{x}">x</a>' for x in links)
        return i, url, f'<html>{tags}<script src="https://cdn.a.com/{script}.js"></script></html>'

    pages = [
        page(1, "https://www.a.com/", ["/two#top", "/admin-login"], "s1"), page(2, "http://WWW.a.com/two/", [], "s2"),
        page(3, "https://www.a.com/admin-login", [], "s3"), page(4, "https://www.a.com/unnamed", [], "s4"),
        page(5, "https://www.b.com/", ["/"], "s5"), page(6, "https://other.a.com/", ["/"], "s6")]
    captures = [(f"https://cdn.a.com/s{i}.js", 200, "text/javascript", f"k = '{KEY}' ;") for i in range(1, 7)]
    hosts = spark.createDataFrame([("www.a.com",), ("WWW.A.com",), ("www.b.com",)], "fqdn string")
    seeds = spark.createDataFrame([("a.com", "a")], "domain string, label string")
    return (hosts, spark.createDataFrame(pages, schemas.PAGES), seeds, spark.createDataFrame([], "url string"),
            spark.createDataFrame(captures, "url string, status int, content_type string, body string"))


def found(rows):
    return {(r.base_url, r.resource_url[-5:-3]) for r in rows.collect()}


def test_only_named_pages_of_known_hosts_are_scanned(spark, mini_rules):
    rows = scan.full_scan(*made(spark), mini_rules)
    assert found(rows) == {
        ("https://www.a.com/", "s1"), ("http://WWW.a.com/two/", "s2"), ("https://www.a.com/admin-login", "s3"),
        ("https://www.b.com/", "s5")}


def test_limits_of_both_hops(spark, mini_rules):
    # The address with a word of high rank comes first, whatever its place on the page.
    first = scan.full_scan(*made(spark), mini_rules, internal_limit=1)
    assert found(first) == {("https://www.a.com/admin-login", "s3")}
    some = scan.full_scan(*made(spark), mini_rules, limit=3)
    assert len(found(some)) < 4


def _exchanged(frame):
    """Columns that any exchange of the plan moves."""
    plan = frame._jdf.queryExecution().optimizedPlan()
    physical = frame._jdf.queryExecution().executedPlan()
    out, todo = set(), [physical]
    while todo:
        node = todo.pop()
        if "Exchange" in node.nodeName():
            out.update(a.name() for a in _items(node.output()))
        todo.extend(_items(node.children()))
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.initialPlan())
    assert plan is not None
    return out


def _items(seq):
    return [seq.apply(i) for i in range(seq.length())]


@pytest.mark.parametrize("name", ["q38_flagship", "q38_flagship_limited", "q40_full_scan", "q40_frontier"])
def test_no_page_or_body_is_moved(spark, name):
    moved = _exchanged(queries.QUERIES[name](spark, DATA))
    assert moved and not {"html", "body", "text"} & moved


def test_limited_scan_tests_addresses_before_it_searches(spark):
    """Below the generator that runs the rules stands the test of the selected addresses."""
    frame = queries.QUERIES["q38_flagship_limited"](spark, DATA)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    generator = plan.index("Generate inline(concat(CASE")
    test = [m.start() for m in re.finditer(r"Filter .*scalar-subquery", plan)]
    assert test and any(t > generator for t in test)
    unlimited = queries.QUERIES["q38_flagship"](spark, DATA)
    assert "scalar-subquery" not in unlimited._jdf.queryExecution().optimizedPlan().toString()


def test_limited_scan_equals_a_cut_of_the_whole(spark):
    rules = suffixes.builtin_rules(spark)
    args = inputs.pages(spark, DATA), queries._seeds(spark, DATA), queries._failed(spark, DATA), inputs.captures(spark, DATA)
    whole = {r for r in scan.leak_scan(*args, rules).collect()}
    for limit in (0, 60, 10**6):
        some = set(scan.leak_scan(*args, rules, limit=limit).collect())
        assert some <= whole and (limit or not some) and (limit < 10**6 or some == whole)
