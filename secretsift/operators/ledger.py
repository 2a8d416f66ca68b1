"""Days of files that runs add to, each run as a whole and once.

A run writes its part files to a hidden folder of its own, which its repetition replaces. Its
files are then moved into the day's folder under names that begin with the run, and the
day's manifest, replaced as a whole, lists the files that count. A run that breaks off
before that has published nothing; one that is repeated under its name replaces what
it published. Runs of one day take turns: the manifest has one writer at a time.

    <path>/scan_date=<day>/<run>-part-00000.csv      published
    <path>/_manifest/<day>.json                      runs of the day, files and rows of each
    <path>/_runs/<run>                               being written
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DAY = "scan_date"


class Ledger:
    """The files under one path, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.FileSystem.get(self._path(self.path).toUri(), spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._path("/".join((self.path, *parts)))

    def days(self) -> list[str]:
        """Days that have a manifest."""
        folder = self._at("_manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(n[:-5] for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, day: str) -> dict[str, dict]:
        """Runs of a day: ``{run: {"files": [...], "rows": n}}``."""
        at = self._at("_manifest", f"{day}.json")
        if not self._fs.exists(at):
            return {}
        return {r["run"]: {"files": r["files"], "rows": r["rows"]} for r in map(
            json.loads, filter(None, self._read(at).split("\n")))}

    def files(self, day: str) -> list[str]:
        """Paths of the files that count."""
        return [f"{self.path}/{DAY}={day}/{f}" for run in self.manifest(day).values() for f in run["files"]]

    def _read(self, at) -> str:
        stream = self._fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _replace(self, at, text: str) -> None:
        """Write a file beside the old one and put it in its place."""
        fresh = self._path(at.getParent(), f".{at.getName()}.new")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.delete(at, False)
        if not self._fs.rename(fresh, at):
            raise OSError(f"cannot replace {at}")

    def publish(self, day: datetime.date, run: str, rows: Callable[[], int], write: Callable[[str], None], alone: bool = False) -> None:
        """Let ``write`` fill a folder and make its part files the run's files of ``day``.

        ``rows`` tells how many rows were written. ``alone`` takes the files of all other runs of the day away.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.]*", run):
            raise ValueError(f"a run is named with letters, digits, _ and ., not {run!r}")
        staged, name = f"{self.path}/_runs/{run}", day.isoformat()
        write(staged)
        folder = self._at(f"{DAY}={name}")
        self._fs.mkdirs(folder)
        known = self.manifest(name)
        found = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(staged)))
        parts = [f for f in found if f.startswith("part-")]
        # Left over from this run's earlier attempts, whether they got into the manifest or not.
        for status in self._fs.listStatus(folder):
            if status.getPath().getName().startswith(f"{run}-"):
                self._fs.delete(status.getPath(), False)
        files = []
        for number, part in enumerate(parts):
            target = f"{run}-part-{number:05}{part[part.index('.'):]}"
            if not self._fs.rename(self._path(staged, part), self._path(folder, target)):
                raise OSError(f"cannot publish {part}")
            files.append(target)
        gone = [f for other, r in known.items() if alone and other != run for f in r["files"]]
        kept = {} if alone else {k: v for k, v in known.items() if k != run}
        lines = [json.dumps({"run": k, **v}) for k, v in (kept | {run: {"files": files, "rows": rows()}}).items()]
        self._fs.mkdirs(self._at("_manifest"))
        self._replace(self._at("_manifest", f"{name}.json"), "\n".join(lines) + "\n")
        for f in gone:
            self._fs.delete(self._path(folder, f), False)
        self._fs.delete(self._path(staged), True)


def counted(df: DataFrame, name: str):
    """``df`` and an observation of its number of rows, made while it is written."""
    from pyspark.sql import Observation, functions as F

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
