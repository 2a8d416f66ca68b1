import json
from datetime import datetime

from secretsift import schemas
from secretsift.plans.scan import host_scan
from secretsift.sources import archive, captures, recon


def payloads(spark, *bodies, domain="x.com", status=200):
    return spark.createDataFrame([(domain, status, b) for b in bodies], schemas.PAYLOADS)


def names(frame):
    return sorted(r.fqdn for r in frame.collect())


def test_certificates(spark):
    body = json.dumps([{"name_value": "*.A.x.com\nadmin@x.com\nb.x.com"}, {"id": 1, "name_value": "a.x.com\n"}])
    broken = json.dumps([{"name_value": "c.x.com"}, {"id": 2}])
    answers = payloads(spark, body, broken, "<html>error</html>").unionByName(
        payloads(spark, json.dumps([{"name_value": "d.x.com"}]), status=502))
    assert names(recon.certificate_names(answers)) == ["a.x.com", "b.x.com"]
    assert names(recon.certificate_names(answers, "intended")) == ["a.x.com", "b.x.com", "c.x.com"]


def test_passive_dns(spark):
    page = ("<table><tr><td>no.x.com</td></tr></table><table class='t' id='table'><tr><td> <b>A.x.com</b>\n</td>"
            "<td>192.0.2.1</td><td>x.com.evil.org</td><td>a&#46;x.com</td></tr></table>")
    assert names(recon.dns_table_cells(payloads(spark, page))) == ["A.x.com", "a.x.com", "x.com.evil.org"]
    assert names(recon.dns_table_cells(payloads(spark, page), "intended")) == ["a.x.com"]


def test_domain_report(spark):
    def body(code):
        return json.dumps({"response_code": code, "subdomains": ["VPN.x.com", "y.org", f"c{code}.x.com"]})

    found = recon.domain_report(payloads(spark, body("1"), body("0"), body(1), "{}", "no json"))
    assert names(found) == ["c1.x.com", "vpn.x.com"]


def test_host_table(spark):
    cell = '<td class="col-md-4">{}</td>'
    page = "".join(cell.format(c) for c in ("mx.x.com. <br>10", "ns.other.org", "", "www.x.com"))
    page += '<td class="col-md-40">no.x.com</td>'
    assert names(recon.host_table(payloads(spark, page))) == ["mx.x.com"]
    assert names(recon.host_table(payloads(spark, page), "intended")) == ["mx.x.com", "www.x.com"]


def test_json_hosts(spark):
    answers = payloads(spark, '<p>["a.x.com.", "b.x.com"]</p>', '["c.x.com"]')
    assert names(recon.json_hosts(answers)) == [" b.x.com", "a.x.com", "c.x.com"]
    assert names(recon.json_hosts(answers, "intended")) == ["a.x.com", "b.x.com", "c.x.com"]


def test_union_keeps_sources(spark):
    tables = {
        "certificates": payloads(spark, json.dumps([{"name_value": "a.x.com"}])),
        "domain_report": payloads(spark, json.dumps({"response_code": "1", "subdomains": ["a.x.com", "b.x.com"]})),
    }
    found = recon.subdomains(tables)
    rows = {r.fqdn: r.sources for r in recon.hosts_with_sources(found).collect()}
    assert rows == {"a.x.com": ["certificates", "domain_report"], "b.x.com": ["domain_report"]}
    assert names(host_scan(tables)) == names(host_scan(dict(reversed(tables.items())))) == ["a.x.com", "b.x.com"]
    seeds = spark.createDataFrame([("x.com",), ("y.com",)], "domain string")
    summary = recon.scan_summary(found, seeds).first()
    assert (summary.n_fqdns, summary.n_seeds, summary.avg_per_seed) == (2, 2, 1.0)


def test_archive_rows(spark):
    body = '[["original"],\n["http://A.com/x"],\n["http://a.com/p,q[1]"],\n["/"]]'
    answers = payloads(spark, body, '[["original"]]', "").withColumnRenamed("domain", "fqdn")
    urls = sorted(r.url for r in archive.archive_rows(answers).collect())
    assert urls == ["http://a.com/p", "http://a.com/x", "q1"]
    urls = sorted(r.url for r in archive.archive_rows(answers, "intended").collect())
    assert urls == ["http://a.com/p,q[1]", "http://a.com/x"]


def test_archive_captures(spark):
    def row(key, year, mime="text/html", status=200, original=None):
        return ("h.com", key, original or f"http://h.com/{key}{year}", mime, status, datetime(year, 12, 31, 23))

    rows = [
        row("a", 2023), row("a", 2022), row("b", 2021), row("c", 2025), row("d", 2024, "image/png"),
        row("e", 2024, status=404), row("f", 2024, status=202), row("g", 2024, "image/svg+xml"),
        row("h", 2024, "image/vnd.adobe.photoshop"),
    ]
    cdx = spark.createDataFrame(rows, schemas.CDX)
    found = {r.urlkey: r.original for r in archive.archive_captures(cdx, 2024).collect()}
    assert found == {"a": "http://h.com/a2022", "f": "http://h.com/f2024", "h": "http://h.com/h2024"}
    assert {r.urlkey for r in archive.archive_captures(cdx, 2024, semantics="intended").collect()} == {"a", "f"}
    assert {r.urlkey for r in archive.archive_captures(cdx, 2024, limit=1).collect()} == {"a"}


def test_archive_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("h", "k", "o", "text/html", 200, datetime(2024, 1, 1))], schemas.CDX).write.parquet(
        str(tmp_path / "cdx"))
    found = archive.usable_captures(spark.read.schema(schemas.CDX).parquet(str(tmp_path / "cdx")), 2024)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "In(statuscode, [200,202])" in plan and "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_page_status(spark):
    from pyspark.sql import functions as F
    rows = [(1, "u1", "<p>ok</p>"), (2, "u2", None), (3, "u3", "cut")]
    pages = spark.createDataFrame(rows, schemas.PAGES)
    usable = F.contains("html", F.lit("</p>"))
    assert {r.url: r.status for r in captures.page_status(pages, usable).collect()} == {
        "u1": "ok", "u2": "failed", "u3": "failed"}
    assert sorted(r.url for r in captures.failed_urls(pages, usable).collect()) == ["u2", "u3"]
