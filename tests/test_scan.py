import hashlib
import re

import pytest
from pyspark.sql import functions as F

from secretsift import schemas
from secretsift.catalog import inputs, queries
from secretsift.operators import detect, report, scope
from secretsift.operators.rules import RULES, rule_table, rules_of
from secretsift.plans import scan
from secretsift.sources import suffixes
from secretsift.streaming.incremental import run_incremental

DATA = "/root/testdata/sf0.001"

A, N = "aB3x" * 30, "0123456789" * 9


def tokens():
    """For each rule a value it has to find, put together here."""
    return {
        "assigned_secret": ("password = \"", A[:8], "\""), "assigned_secret_single": ("'api_key': '", A[:9], "'"),
        "aws_access_key": ("", "AK" + "IA" + "ABCD" * 4, ""), "google_api_key": ("", "AI" + "za" + A[:35], ""),
        "google_oauth_token": ("", "ya" + "29." + A[:20], ""), "azure_account_key": ("AccountKey=", A[:86] + "==", ""),
        "digitalocean_token": ("", "dop" + "_v1_" + N[:64], ""),
        "database_url": ("", "postgres" + "://u:" + A[:5] + "@db/x", ""),
        "jdbc_password": ("", "jdbc:" + "mysql://h/x?password=" + A[:4], ""),
        "json_web_token": ("", "ey" + "J" + A[:8] + ".ey" + "J" + A[:8] + "." + A[:8], ""),
        "bearer_token": ("bearer ", A[:16], ""), "github_token": ("", "gh" + "p_" + A[:36], ""),
        "github_fine_grained_token": ("", "github" + "_pat_" + A[:82], ""),
        "gitlab_token": ("", "gl" + "pat-" + A[:20], ""), "slack_token": ("", "xo" + "xb-" + A[:10], ""),
        "stripe_key": ("", "sk" + "_live_" + A[:24], ""),
        "sendgrid_key": ("", "S" + "G." + A[:22] + "." + A[:43], ""), "npm_token": ("", "np" + "m_" + A[:36], ""),
        "private_key": ("", "-----BEGIN EC " + "PRIVATE KEY-----", ""),
        "url_login": ("https://", "u:" + A[:3], "@h.com"),
        "slack_webhook": ("", "https://hooks.slack" + ".com/services/T0/B0/" + A[:4], ""),
    }


def found(spark, texts, rules=RULES):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {(r.i, r.rule, r.value) for r in detect.find_credentials(frame, "text", rules, raw=True).collect()}


def test_every_rule_finds_its_token(spark):
    known = tokens()
    assert set(known) == {r.name for r in RULES}
    texts = [f"x {a}{v}{b} y; {a}{v}{b}" for a, v, b in known.values()]
    hits = found(spark, texts)
    for i, (name, (_, value, _)) in enumerate(known.items()):
        assert (i, name, value) in hits, name


FIXED = ["aws_access_key", "google_api_key", "azure_account_key", "digitalocean_token", "github_token",
         "github_fine_grained_token", "gitlab_token", "sendgrid_key", "npm_token", "private_key"]


@pytest.mark.parametrize("shape", ["{a}{short}", "{a}{short}{b} ", "Z{a}{v}", "{a}{v}Z"])
def test_near_misses(spark, shape):
    known = tokens()
    names = [n for n in FIXED if not (shape == "Z{a}{v}" and n in ("azure_account_key", "private_key"))]
    names = [n for n in names if not (shape == "{a}{v}Z" and n in ("azure_account_key", "private_key"))]
    texts = []
    for n in names:
        a, v, b = known[n]
        texts.append(" " + shape.format(a=a, v=v, b=b, short=v[:-1]))
    assert found(spark, texts) == set()


def test_rules_equal_plain_regex_search(spark):
    docs = inputs.table(spark, DATA, "documents").selectExpr("doc_id", f"{inputs.ALL_SECRETS} AS text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = detect.find_credentials(docs, "text", raw=True).collect()
    got = sorted((r.doc_id, r.rule, r.value) for r in rows)
    want = sorted(
        (d, rule.name, m.group(rule.group))
        for d, t in texts.items() for rule in RULES for m in re.finditer(rule.regex, t))
    assert got == want
    assert all(r.fingerprint == hashlib.sha256(r.value.encode()).hexdigest() for r in rows)


def test_raw_values_only_on_request(spark):
    frame = spark.createDataFrame([(1, tokens()["github_token"][1])], "i int, text string")
    assert "value" not in detect.find_credentials(frame, "text").columns


def test_candidate_lists(spark):
    key, other = tokens()["github_token"][1], tokens()["gitlab_token"][1]
    frame = spark.createDataFrame([("b", "r", f"{key} {key} {other}"), ("b", "s", "none")],
                                  "base_url string, resource_url string, text string")
    rows = detect.candidates_per_text(frame, "text", rules_of("auth")).collect()
    want = sorted(hashlib.sha256(v.encode()).hexdigest() for v in (key, other))
    assert [(r.resource_url, r.candidates, r.n_candidates) for r in rows] == [("r", want, 2)]
    assert rule_table(spark).count() == len(RULES)


def resources(spark, urls, part=1):
    rows = [(u, part) for u in urls]
    return spark.createDataFrame(rows, "resource_url string, part int")


def test_scope(spark, mini_rules):
    seeds = spark.createDataFrame([("corp.com", "corp"), ("rp.org", "rp"), ("x.net", "x")],
                                  "domain string, label string")
    urls = ["https://a.corp.com/", "https://corporate-evil.com/", "https://rp.org/", "https://corp/",
            "https://other.org/x"]
    want = sorted([(urls[0], "corp"), (urls[0], "rp"), (urls[1], "corp"), (urls[1], "rp"), (urls[2], "rp")])
    for inline in (10, 0):
        rows = scope.in_scope(resources(spark, urls), seeds, mini_rules, inline=inline).collect()
        assert sorted((r.resource_url, r.seed) for r in rows) == want
        rows = scope.in_scope(resources(spark, urls), seeds, mini_rules, "intended", inline).collect()
        assert sorted((r.resource_url, r.seed) for r in rows) == [(urls[0], "corp.com"), (urls[2], "rp.org")]
        free = scope.in_scope(resources(spark, urls, part=3), seeds, mini_rules, inline=inline)
        assert free.count() == len(urls)


def test_empty_label_owns_everything(spark, mini_rules):
    seeds = spark.createDataFrame([("", "")], "domain string, label string")
    urls = ["https://a.com/", "https://nosuffix/"]
    for inline in (10, 0):
        assert scope.in_scope(resources(spark, urls), seeds, mini_rules, inline=inline).count() == 2
        assert scope.in_scope(resources(spark, urls), seeds, mini_rules, "intended", inline).count() == 0


def findings(spark, *prints):
    rows = [("https://a.b.com/", "https://a.b.com/x;y.js", "b.com", "r", "auth", "m***", p) for p in prints]
    return spark.createDataFrame(rows, schemas.FINDINGS)


def test_report_files(spark, tmp_path):
    import datetime
    path, day = str(tmp_path / "out"), datetime.date(2026, 1, 2)
    report.write_report(findings(spark, "f1"), path, day)
    report.write_report(findings(spark, "f2"), path, day)
    report.write_report(findings(spark, "f3"), path, day + datetime.timedelta(1))
    assert sorted(r.fingerprint for r in report.read_report(spark, path).collect()) == ["f1", "f2", "f3"]
    report.write_report(findings(spark, "f4"), path, day, replace_day=True)
    rows = report.read_report(spark, path).collect()
    assert sorted((str(r.scan_date), r.fingerprint) for r in rows) == [("2026-01-02", "f4"), ("2026-01-03", "f3")]
    assert rows[0].resource_url == "https://a.b.com/x;y.js"
    header = next((tmp_path / "out").glob("scan_date=2026-01-02/*.csv")).read_text().splitlines()[0]
    assert header == ("Base URL;Affected Network Resource from Base URL;Registered Domain Base URL;"
                      "Credential Leak Candidate")
    parquet = str(tmp_path / "pq")
    report.write_report(findings(spark, "f1"), parquet, day, "parquet")
    assert set(schemas.FINDINGS.names) < set(spark.read.parquet(parquet).columns)


def test_leak_scan_finds_the_planted_key(spark, mini_rules):
    key = tokens()["github_token"][1]
    pages = spark.createDataFrame([
        (1, "https://www.x.com/", "<script src=/app.js></script><script src=https://cdn.y.org/z.js></script>"),
        (2, "https://www.x.com/login", "<script src=/app.js></script><script src=/bad.js></script>"),
    ], schemas.PAGES)
    captured = spark.createDataFrame([
        ("https://www.x.com/app.js", 200, "text/javascript", f"k='{key}'"),
        ("https://www.x.com/app.js", 200, "text/javascript", f"k='{key}'"),
        ("https://cdn.y.org/z.js", 200, "text/javascript", f"k='{key}'"),
        ("https://www.x.com/bad.js", 200, "text/javascript", f"k='{key}'"),
    ], schemas.CAPTURES)
    seeds = spark.createDataFrame([("x.com", "x")], "domain string, label string")
    failed = spark.createDataFrame([("https://www.x.com/bad.js",)], "url string")
    for limit in (100, 100_000, None):
        rows = scan.leak_scan(pages, seeds, failed, captured, mini_rules, limit).collect()
        assert [(r.base_url, r.resource_url, r.registered_domain, r.rule) for r in rows] == [
            ("https://www.x.com/login", "https://www.x.com/app.js", "x.com", "github_token")]
    assert scan.leak_scan(pages, seeds, failed, captured, mini_rules, 1).count() == 0


def test_incremental_runs(spark, mini_rules, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    seeds = spark.createDataFrame([("x.com", "x")], "domain string, label string")

    def add(*names):
        rows = [(i, "https://x.com/", f"<script src=/{n}.js></script>") for i, n in enumerate(names)]
        spark.createDataFrame(rows, schemas.PAGES).coalesce(1).write.mode("append").parquet(source)

    def run():
        table = run_incremental(spark, source, target, state, seeds, mini_rules, files_per_batch=1)
        return sorted(r.resource_url.rsplit("/", 1)[1] for r in table.collect())

    add("a", "b", "a")
    assert run() == ["", "a.js", "b.js"]
    add("b", "c")
    add("c", "d")
    assert run() == ["", "a.js", "b.js", "c.js", "d.js"]
    assert run() == ["", "a.js", "b.js", "c.js", "d.js"]


@pytest.mark.parametrize("name", ["q17_internal_links", "q22_network_resources", "q24_dedup_last", "q26_not_failed",
                                  "q29_tiered_limit", "q31_findings_generic", "q37_report", "q38_flagship"])
def test_plans(spark, name):
    frame = queries.QUERIES[name](spark, DATA)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval"):
        assert word not in plan, word


def test_scans_read_only_what_they_use(spark):
    plan = queries.QUERIES["q36_fingerprint_counts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan
    rules = suffixes.builtin_rules(spark)
    pages = inputs.table(spark, DATA, "pages")
    hosts = scan.internal_url_scan(pages, rules, 10).select("url")
    assert hosts.where(F.col("url").isNull()).count() == 0


def test_scope_does_not_depend_on_the_number_of_seeds(spark, mini_rules):
    from secretsift.operators import extract, scope

    link = max(extract.SELF, extract.IMPORT) + 1
    rows = [("https://www.abc.com/x", link), ("https://abcd.abc.com/y", link), ("https://other.org/", link),
            ("https://nowhere", link), ("https://far.net/", extract.SELF), ("https://far.net/i.js", extract.IMPORT)]
    resources = spark.createDataFrame(rows, "resource_url string, part int")
    seeds = spark.createDataFrame([("abc.com", "abc"), ("abcd.com", "abcd"), ("bc.com", "bc"), ("x", "y" * 300)],
                                  "domain string, label string")
    for each in (True, False):
        few, many = (
            sorted(map(repr, scope.in_scope(resources, seeds, mini_rules, inline=n, each_seed=each).select(
                "resource_url", "part", *["seed"] * each).collect())) for n in (10, 0))
        assert few == many and few


def test_no_limit_keeps_everything(spark):
    from secretsift.operators import prioritize

    ranked = spark.range(500).selectExpr("CAST(id % 3 AS int) AS tier", "struct(id AS page_id, id AS tag_no) AS seq")
    assert prioritize.select_first(ranked).count() == 500
