import random

from pyspark.sql import functions as F

from secretsift.operators.domains import with_domain_parts
from secretsift.sources.seeds import read_seed_lines, seed_domains
from secretsift.sources.suffixes import builtin_rules, prepare_rules, read_rules

CASES = {
    # host: (registered domain, label, full name)
    "a.b.example.com": ("example.com", "example", "a.b.example.com"),
    "x.co.uk": ("x.co.uk", "x", "x.co.uk"),
    "co.uk": ("", "", ""),
    "me.github.io": ("me.github.io", "me", "me.github.io"),
    "github.io": ("", "", "github.io"),
    "a.foo.ck": ("a.foo.ck", "a", "a.foo.ck"),
    "q.foo.bar.ck": ("foo.bar.ck", "foo", "q.foo.bar.ck"),
    "z.www.ck": ("www.ck", "www", "z.www.ck"),
    "localhost": ("", "localhost", ""),
    "192.0.2.7": ("", "192.0.2.7", ""),
    "Shop.Example.COM": ("Example.COM", "Example", "Shop.Example.COM"),
    "": ("", "", ""),
}


def parts(spark, hosts, rules):
    rows = spark.createDataFrame(list(enumerate(hosts)), "i int, h string")
    found = with_domain_parts(rows, "h", rules, "registered", "label", "fqdn").collect()
    return [(r.registered, r.label, r.fqdn) for r in sorted(found, key=lambda r: r.i)]


def test_vectors(spark, mini_rules):
    assert parts(spark, list(CASES), mini_rules) == list(CASES.values())


def test_without_private_rules(spark):
    rows = spark.createDataFrame([("io", False), ("github.io", True)], "rule string, private boolean")
    rules = prepare_rules(rows, include_private=False)
    assert parts(spark, ["me.github.io"], rules) == [("github.io", "github", "me.github.io")]


def test_against_brute_force(spark, mini_rules):
    rules = {"com", "org", "net", "uk", "co.uk", "io", "github.io"}
    rng = random.Random(4)
    labels = ["a", "www", "ck", "co", "uk", "com", "io", "github", "zz"]
    hosts = [".".join(rng.choices(labels, k=rng.randint(1, 5))) for _ in range(300)]

    def registered(host):
        names = host.split(".")
        best = 0
        for d in range(1, len(names) + 1):
            tail = ".".join(names[-d:])
            if tail == "www.ck":
                best = 1
                break
            if tail in rules or (d > 1 and ".".join(names[-d + 1:]) == "ck"):
                best = max(best, d)
        return ".".join(names[-best - 1:]) if best and len(names) > best else ""

    assert [p[0] for p in parts(spark, hosts, mini_rules)] == [registered(h) for h in hosts]


def test_no_shuffle(spark, mini_rules):
    plan = with_domain_parts(
        spark.range(10).select(F.concat("id", F.lit(".com")).alias("h")), "h", builtin_rules(spark), "r"
    )._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_read_rules(spark, tmp_path):
    text = "// a list\ncom\n*.ck extra\n!www.ck\n\n// ===BEGIN PRIVATE DOMAINS===\ngithub.io\n"
    (tmp_path / "list.dat").write_text(text)
    found = {(r.rule, r.private) for r in read_rules(spark, str(tmp_path / "list.dat")).collect()}
    assert found == {("com", False), ("*.ck", False), ("!www.ck", False), ("github.io", True)}


def test_seeds(spark, mini_rules, tmp_path):
    lines = "\ufeff# comment\n\nSub.Example.com, \nlocalhost\n#x.com\na.com,b.com\nhttps://c.org/x\n"
    path = tmp_path / "domains.txt"
    path.write_text(lines, encoding="utf-8")
    seeds = seed_domains(read_seed_lines(spark, str(path)), mini_rules)
    assert sorted(r.domain for r in seeds.collect()) == ["", "c.org", "comb.com", "example.com"]
    intended = seed_domains(read_seed_lines(spark, str(path)), mini_rules, "intended")
    assert sorted((r.domain, r.label) for r in intended.collect()) == [
        ("a.com", "a"), ("b.com", "b"), ("c.org", "c"), ("example.com", "example")]
