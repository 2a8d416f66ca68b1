"""Many seeds against a plain substring test, and against the form for few seeds."""

import random

import pytest
from pyspark.sql import functions as F

from secretsift.operators import scope
from secretsift.operators.extract import EMBEDDED, SELF


def _words(seed, n, least, most):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice("abc-é1") for _ in range(rng.randrange(least, most))) for _ in range(n)})


@pytest.mark.parametrize("labels", [
    _words(1, 60, 3, 6), _words(2, 40, 0, 5), ["", "a"], ["x" * 260, "abc"], ["zzz", "zz", "z"], []])
def test_pairs_equal_the_substring_test(spark, labels):
    names = _words(3, 120, 0, 12) + ["com", "x" * 300, "ab"]
    names = sorted(set(names))
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    found = scope.owners_by_gram(frame, "name", spark.createDataFrame([(s,) for s in labels], "label string"), "label")
    rows = [(r.name, r.label) for r in found.collect()]
    assert sorted(rows) == sorted((n, s) for n in names for s in labels if s in n)


@pytest.mark.parametrize("each_seed", [True, False])
def test_both_forms_agree(spark, mini_rules, each_seed):
    """Also for labels longer than a host name may be, repeated labels, and the empty one."""
    long = "y" * 260
    urls = ["https://www.shop.com/a", "https://ab.net/b", f"https://{long}.com/", "https://10.0.0.1/x", "nothing", "https://cdn.io/"]
    rows = [(f"https://o{i}.com/", u, i, part, (i, part)) for i, u in enumerate(urls) for part in (SELF, EMBEDDED)]
    found = spark.createDataFrame(rows, "origin_url string, resource_url string, page_id long, part int, seq struct<a:int,b:int>")
    for labels in (["shop", "hop", "b"], [long, "shop"], ["shop", "shop", "cdn"], ["", "ab"], ["none"]):
        seeds = spark.createDataFrame([(f"{s}.com", s) for s in labels], "domain string, label string")
        few, many = (scope.in_scope(found, seeds, mini_rules, inline=n, each_seed=each_seed) for n in (1000, 0))
        assert sorted(map(repr, few.collect())) == sorted(map(repr, many.select(few.columns).collect()))


def test_a_name_meets_only_labels_of_its_rarest_grams(spark):
    """A gram that all names share is in no entry of a label that has a rarer one."""
    names = spark.createDataFrame([(f"host{i:03}.com",) for i in range(300)], "name string")
    labels = spark.createDataFrame([(f"t{i:03}.com",) for i in range(0, 300, 3)], "label string")
    pairs = scope.owners_by_gram(names, "name", labels, "label")
    assert pairs.count() == 100
    index = scope._grams(F.col("name"))
    assert names.select(F.max(F.size(index) - F.length("name"))).first()[0] <= 0
