import random

import pytest
from pyspark.sql import functions as F

from secretsift.functions.patterns import (
    HIGH, INTERNAL, MEDIUM, RESOURCE, pattern_table, url_patterns,
)
from secretsift.operators import dedup, prioritize, topk
from secretsift.session import INTENDED, REFERENCE

RESOURCE_TIERS = {
    # URL: reference rank, intended rank
    "https://a.com/app.js": (2, 1), "https://a.com/x.json": (2, 1), "https://a.com/old/app.js": (1, 1),
    "https://blog.a.com/x": (1, 1), "https://a.com/README": (1, 1), "https://a.com/auth/app.js": (0, 0),
    "https://a.com/monkey": (0, 0), "https://a.com/cache/x": (0, 0), "https://a.com/docker/Dockerfile": (2, 1),
    "https://a.com/.git/HEAD": (2, 0), "https://a.com/q": (2, 2), "https://a.com/elasticsearch": (2, 0),
    "https://a.com/deploymentelasticsearch": (0, 0), r"https://a.com/\.git": (0, 0),
}
INTERNAL_TIERS = {
    "https://www.a.com/admin/": (0, 0), "https://dev.a.com/": (2, 0), "https://api.a.com/": (2, 0),
    "https://dev-1.a.com/": (0, 0), "https://a.com/v1/internal/x": (0, 0), "https://a.com/about": (2, 2),
    r"https://a.com/dev\.x": (0, 2),
}


@pytest.mark.parametrize("cases,tier", [
    (RESOURCE_TIERS, prioritize.resource_tier), (INTERNAL_TIERS, prioritize.internal_tier)])
def test_tiers(apply, cases, tier):
    for i, semantics in enumerate((REFERENCE, INTENDED)):
        got = apply(lambda c, s=semantics: tier(c, s), list(cases))
        assert dict(zip(cases, got)) == {u: t[i] for u, t in cases.items()}


def test_pattern_counts(spark):
    counts = [(len(p), sum(x.live for x in p)) for p in (
        url_patterns(INTERNAL, HIGH), url_patterns(RESOURCE, HIGH), url_patterns(RESOURCE, MEDIUM))]
    assert counts == [(293, 116), (149, 146), (50, 20)]
    assert pattern_table(spark).count() == 293 + 149 + 50


def test_any_match_equals_plain_search(apply):
    rng = random.Random(1)
    words = [p.pattern for p in url_patterns(RESOURCE, HIGH)]
    urls = ["https://a.com/" + "".join(rng.choices("abcdefgiklnoprstuv3-./\\", k=12)) for _ in range(300)]
    urls += [f"https://x.org/Q{w.upper()}z" for w in words]
    want = [any(w in u.lower() for w in words) for u in urls]
    from secretsift.functions.patterns import matches_any
    assert apply(lambda c: matches_any(c, RESOURCE, HIGH), urls) == want


def ranked(spark, tiers):
    rows = [(i, t) for i, t in enumerate(tiers)]
    frame = spark.createDataFrame(rows, "n long, tier int")
    return frame.select("n", "tier", F.struct(F.col("n").alias("page_id")).alias("seq"))


@pytest.mark.parametrize("limit,counts", [(2, (2, 0, 0)), (4, (3, 1, 0)), (7, (3, 2, 2)), (20, (3, 2, 4))])
def test_tiered_limit(spark, limit, counts):
    frame = ranked(spark, [2, 0, 1, 2, 0, 2, 1, 0, 2])
    chosen = [r.tier for r in prioritize.select_first(frame, limit).collect()]
    assert tuple(chosen.count(t) for t in range(3)) == counts and chosen == sorted(chosen)


def test_empty_limit(spark):
    assert prioritize.select_first(ranked(spark, [0]).limit(0), 5).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_range_selection_equals_sort(spark, seed):
    rng = random.Random(seed)
    # A third of the rows share one leading value; values are uneven.
    rows = [(7 if rng.random() < 0.33 else int(rng.paretovariate(0.4)) % 10**12, i, rng.randint(0, 2))
            for i in range(5000)]
    frame = spark.createDataFrame(rows, "lead long, n long, tier int").repartition(7)
    for k in (0, 1, 37, 1700, 4999, 9000):
        got = topk.first_rows(frame, "tier", "lead", ["lead", "n"], k, plain=0)
        want = sorted((t, a, n) for a, n, t in rows)[:k]
        assert [(r.tier, r.lead, r.n) for r in got.collect()] == want


def test_large_limit_goes_through_a_table(spark):
    frame = ranked(spark, [i % 3 for i in range(300)])
    assert prioritize.select_first(frame, 100_000).count() == 300


def test_first_per_group_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randint(0, 200)}", f"{i:05d}") for i in range(4000)]
    rng.shuffle(rows)
    for parts in (1, 7, 64):
        frame = spark.createDataFrame(rows, "g string, o string").repartition(parts)
        for k, spread in ((1, 8), (5, 4096), (300, 16)):
            got = {tuple(r) for r in topk.first_per_group(frame, ["g"], ["o"], k, spread).collect()}
            groups = {}
            for g, o in sorted(rows):
                groups.setdefault(g, []).append(o)
            assert got == {(g, o) for g, os in groups.items() for o in os[:k]}


def resources(spark, pairs):
    rows = [(o, s, (i, 0, 0, 0)) for i, (o, s) in enumerate(pairs)]
    return spark.createDataFrame(
        rows, "origin_url string, resource_url string, "
        "seq struct<page_id:long,part:int,tag_no:int,item_no:int>")


def pairs(frame):
    return [(r.origin_url, r.resource_url) for r in frame.orderBy("seq").collect()]


def test_dedup(spark):
    frame = resources(spark, [("o1", "s1"), ("o2", "s2"), ("o3", "s1")])
    last = dedup.keep_last_origin(frame)
    assert pairs(last) == [("o3", "s1"), ("o2", "s2")]
    assert pairs(dedup.keep_first_origin(frame)) == [("o1", "s1"), ("o2", "s2")]
    failed = spark.createDataFrame([("s2",)], "url string")
    assert pairs(dedup.without_failed(last, failed)) == [("o3", "s1")]


def test_dedup_does_not_depend_on_partitions(spark):
    rng = random.Random(9)
    rows = [(f"o{i}", "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 300)}") for i in range(3000)]
    frame = resources(spark, rows)
    want = pairs(dedup.keep_last_origin(frame.repartition(1)))
    assert len({s for _, s in want}) == len(want)
    for parts in (7, 64):
        assert pairs(dedup.keep_last_origin(frame.repartition(parts))) == want


def test_distribution(spark):
    frame = ranked(spark, [0, 0, 0, 1, 1, 2, 2, 2, 2])
    total = spark.createDataFrame([(18,)], "n long")
    rows = {r.tier: r for r in prioritize.priority_distribution(frame, total, 4).collect()}
    assert (rows["high"].found, rows["high"].found_pct, rows["high"].selected_pct) == (3, 16.7, 75.0)
    assert [rows[t].selected for t in ("high", "medium", "low")] == [3, 1, 0]
