"""The findings report and its files."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from secretsift import schemas
from secretsift.functions.text import once
from secretsift.functions.urls import host_of
from secretsift.operators import ledger
from secretsift.operators.domains import with_domain_parts
from secretsift.sources.suffixes import SuffixRules

# Column titles of the report file.
TITLES = {
    "base_url": "Base URL",
    "resource_url": "Affected Network Resource from Base URL",
    "registered_domain": "Registered Domain Base URL",
    "fingerprint": "Credential Leak Candidate",
}


def report_rows(findings: DataFrame, rules: SuffixRules) -> DataFrame:
    """Findings with the registered domain of their base URL, without repeats."""
    hosts = once(findings, _host=host_of(F.col("base_url")))
    named = with_domain_parts(hosts, "_host", rules, registered="registered_domain")
    return named.select(*schemas.FINDINGS.names).distinct()


def write_report(
    report: DataFrame,
    path: str,
    day: datetime.date | None = None,
    file_format: str = "csv",
    replace_day: bool = False,
    run: str | None = None,
) -> None:
    """Append findings under ``path`` in a folder per day.

    CSV files have a header, ``;`` between columns and the four report columns; a day without
    findings has a file with the header alone. Parquet keeps all columns. Rows appear as a whole when
    the run is done (see ``ledger``); a run that is repeated under its name ``run`` replaces its
    rows. ``replace_day`` puts the rows in place of all earlier ones of the day.
    """
    rows = report
    if file_format == "csv":
        rows = rows.select(*[F.col(c).alias(t) for c, t in TITLES.items()])
    _publish(rows, path, day, file_format, replace_day, run)


def write_wide(
    listed: DataFrame,
    path: str,
    rules: SuffixRules,
    day: datetime.date | None = None,
    replace_day: bool = False,
    run: str | None = None,
) -> None:
    """The report with a line per resource: three columns, then its candidates, as many as it has.

    ``listed`` is what ``detect.candidates_per_text`` gives. Lines differ in length under the same
    four titles, so they are written as text, with the marks CSV needs.
    """
    def cell(c: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(F.rlike(c, F.lit('[;"\\r\\n]')), quoted).otherwise(c)

    hosts = once(listed, _host=host_of(F.col("base_url")))
    named = with_domain_parts(hosts, "_host", rules, registered="registered_domain")
    first = [F.coalesce(cell(F.col(c)), F.lit("")) for c in ("base_url", "resource_url", "registered_domain")]
    line = F.concat_ws(";", *first, F.transform("candidates", cell))
    _publish(named.select(line.alias(";".join(TITLES.values()))), path, day, "wide", replace_day, run)


def _publish(rows, path, day, file_format, replace_day, run) -> None:
    day = day or datetime.date.today()
    run = run or f"run{uuid.uuid4().hex}"
    counted, seen = ledger.counted(rows, f"report-{uuid.uuid4().hex}")
    writer = counted.write.mode("overwrite")

    def write(folder: str) -> None:
        if file_format == "csv":
            writer.option("sep", ";").option("header", True).csv(folder)
        elif file_format == "wide":
            # One column that holds whole lines: nothing in it is to be quoted again.
            writer.option("sep", "\u0001").option("quote", "").option("header", True).option(
                "emptyValue", "").csv(folder)
        else:
            writer.format(file_format).save(folder)

    ledger.Ledger(rows.sparkSession, path).publish(day, run, lambda: seen.get["rows"], write, replace_day)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Read the CSV report back with the short column names; only files that a manifest lists."""
    held = ledger.Ledger(spark, path)
    files = [f for day in held.days() for f in held.files(day)]
    titles = ", ".join(f"`{t}` string" for t in TITLES.values())
    if not files:
        none = spark.createDataFrame([], titles)
        titled = none.withColumn("scan_date", F.lit(None).cast("date"))
    else:
        reader = spark.read.schema(f"{titles}, scan_date date").option("basePath", path)
        titled = reader.option("sep", ";").option("header", True).csv(files)
    return titled.select(*[F.col(f"`{t}`").alias(c) for c, t in TITLES.items()], "scan_date")


def wide_report(listed: DataFrame) -> DataFrame:
    """One line per resource with its candidates joined by ``;``."""
    return listed.select(
        "base_url", "resource_url", F.array_join("candidates", ";").alias("candidates")
    )
