"""Report files: empty days, repeated and broken runs, wide lines."""

import csv
import datetime
import json

import pytest
from pyspark.sql import functions as F

from secretsift import schemas
from secretsift.operators import ledger, report

DAY = datetime.date(2026, 3, 4)
TITLES = list(report.TITLES.values())


def findings(spark, *prints):
    rows = [("https://a.b.com/", "https://a.b.com/x;y.js", "b.com", "r", "auth", "m***", p) for p in prints]
    return spark.createDataFrame(rows, schemas.FINDINGS)


def found(spark, path):
    return sorted((str(r.scan_date), r.fingerprint) for r in report.read_report(spark, path).collect())


def test_empty_day_has_a_header(spark, tmp_path):
    report.write_report(findings(spark), str(tmp_path), DAY)
    files = list((tmp_path / "scan_date=2026-03-04").glob("*.csv"))
    assert [f.read_text().splitlines() for f in files] == [[";".join(TITLES)]]
    rows = report.read_report(spark, str(tmp_path))
    assert rows.columns == [*report.TITLES, "scan_date"] and rows.count() == 0
    # Also where the plan has no partition at all.
    report.write_report(findings(spark, "f1").where(F.lit(False)), str(tmp_path), DAY, run="none")
    report.write_report(findings(spark, "f1"), str(tmp_path), DAY)
    assert found(spark, str(tmp_path)) == [("2026-03-04", "f1")]


def test_nothing_written_yet(spark, tmp_path):
    rows = report.read_report(spark, str(tmp_path / "new"))
    assert rows.columns == [*report.TITLES, "scan_date"] and rows.count() == 0


def test_repeated_run_leaves_no_second_copy(spark, tmp_path):
    path = str(tmp_path)
    report.write_report(findings(spark, "f1", "f2").repartition(2), path, DAY, run="r1")
    report.write_report(findings(spark, "f9"), path, DAY, run="r2")
    report.write_report(findings(spark, "f1", "f2", "f3"), path, DAY, run="r1")
    assert [p for _, p in found(spark, path)] == ["f1", "f2", "f3", "f9"]
    held = ledger.Ledger(spark, path)
    assert {k: v["rows"] for k, v in held.manifest("2026-03-04").items()} == {"r1": 3, "r2": 1}
    # Every file in the folder is one that counts.
    names = {f.name for f in (tmp_path / "scan_date=2026-03-04").glob("[!.]*")}
    assert names == {f for v in held.manifest("2026-03-04").values() for f in v["files"]}


@pytest.mark.parametrize("where", ["rename", "manifest"])
def test_run_that_breaks_off_is_not_read(spark, tmp_path, monkeypatch, where):
    """After the files are written, or between publishing them and the manifest."""
    path = str(tmp_path)
    report.write_report(findings(spark, "f1"), path, DAY, run="r1")
    with monkeypatch.context() as m:
        if where == "manifest":
            m.setattr(ledger.Ledger, "_replace", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        else:
            m.setattr(ledger.Ledger, "manifest", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            report.write_report(findings(spark, "f2"), path, DAY, run="r2")
    assert [p for _, p in found(spark, path)] == ["f1"]
    report.write_report(findings(spark, "f2"), path, DAY, run="r2")
    assert [p for _, p in found(spark, path)] == ["f1", "f2"]


def test_replaced_day(spark, tmp_path):
    path = str(tmp_path)
    for run in ("r1", "r2"):
        report.write_report(findings(spark, run), path, DAY, run=run)
    report.write_report(findings(spark, "other"), path, DAY + datetime.timedelta(1))
    report.write_report(findings(spark), path, DAY, replace_day=True)
    assert found(spark, path) == [("2026-03-05", "other")]
    assert len(list((tmp_path / "scan_date=2026-03-04").glob("*.csv"))) == 1


def test_run_names(spark, tmp_path):
    with pytest.raises(ValueError):
        report.write_report(findings(spark, "f"), str(tmp_path), DAY, run="../x")


def test_wide_lines(spark, mini_rules, tmp_path):
    """Three columns and as many candidates as a resource has, as a CSV reader sees them."""
    rows = [("https://a.b.co.uk/x", "https://a.b.co.uk/p;q.js", ["f1", "f2", 'f"3']), ("https://c.com/", "https://c.com/z.js", ["f4"]),
            ("nothing", None, ["f5"])]
    listed = spark.createDataFrame(rows, "base_url string, resource_url string, candidates array<string>")
    report.write_wide(listed.coalesce(1), str(tmp_path), mini_rules, DAY)
    report.write_wide(listed.limit(0), str(tmp_path), mini_rules, DAY + datetime.timedelta(1))
    file = next((tmp_path / "scan_date=2026-03-04").glob("*.csv"))
    with file.open(newline="") as f:
        lines = list(csv.reader(f, delimiter=";"))
    assert lines[0] == TITLES
    assert sorted(lines[1:]) == sorted([
        ["https://a.b.co.uk/x", "https://a.b.co.uk/p;q.js", "b.co.uk", "f1", "f2", 'f"3'],
        ["https://c.com/", "https://c.com/z.js", "c.com", "f4"], ["nothing", "", "", "f5"]])
    empty = next((tmp_path / "scan_date=2026-03-05").glob("*.csv"))
    assert empty.read_text().splitlines() == [";".join(TITLES)]
    manifest = (tmp_path / "_manifest" / "2026-03-04.json").read_text()
    assert json.loads(manifest)["rows"] == 3
