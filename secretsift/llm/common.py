"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from secretsift.session import cut_lineage, work_folder

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(text: Column) -> Column:
    """A text, where null counts as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` under the shared work folder and read it back.

    The shuffle files behind it are released as soon as it is written, so the
    stages of a long operator do not add up on the executors' disks.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return cut_lineage(df)
    finally:
        conf.set(_CLEANUP, before)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def released(*frames: DataFrame) -> None:
    """Remove tables made by ``stored`` that no unfinished result reads any more."""
    for df in frames:
        files = df.inputFiles()
        if files:
            store, folder = store_of(files[0].rpartition("/")[0])
            _, base = store_of(work_folder(df.sparkSession))
            if folder.startswith(base.rstrip("/") + "/"):
                store.delete_dir(folder)


def id_cuts(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts`` sorted values of ``column`` that cut it into ranges of like size.

    The first is its minimum. Empty for a table without non-null values. What
    reaches the driver is bounded by ``parts``, whatever the table's size.
    """
    shares = [i / parts for i in range(parts)]
    row = df.agg(
        F.min(column).alias("least"),
        F.percentile_approx(column, shares, max(10_000, 10 * parts)).alias("cuts"),
    ).first()
    return [] if row.least is None else sorted({row.least, *row.cuts})


def range_of(value: Column, cuts: list[int]) -> Column:
    """Number of ``cuts`` at or below ``value``; 0 for null.

    Looked up in two steps, so a row costs about twice the root of their number.
    """
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]

    def at_most(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c <= value))

    firsts = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    members = F.array(*[F.array(*[F.lit(c).cast("long") for c in g]) for g in groups])
    group = at_most(firsts)
    inside = F.get(members, group - 1)
    return F.when(value < cuts[0], 0).otherwise(
        F.coalesce((group - 1) * step + at_most(inside), F.lit(0)))


def numbered(df: DataFrame, key: str, *columns: Column) -> DataFrame:
    """``row_id`` and ``columns`` of each row, where ``row_id`` is unique and ordered as ``key``.

    Unique ids are taken as they are. Else (nulls or repeated ids, nulls first)
    the rows are stored in order of ``key`` and numbered.
    """
    kept = df.select(F.col(key).cast("long").alias("row_id"), *columns)
    held = df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("ids")).first()
    if held.rows == held.ids:
        return kept
    ordered = kept.repartitionByRange("row_id").sortWithinPartitions("row_id")
    return stored(ordered.withColumn("row_id", F.monotonically_increasing_id()))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every node in ``links`` (``a``, ``b``): the smallest node it reaches.

    Alternates two steps until nothing changes: every node passes its smallest
    neighbour to its larger ones, then to its smaller ones. Each step is a
    grouped minimum and a join, so a node with any number of links is only a
    skewed key; every round is stored.
    """
    edges = stored(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _digest(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("of"), F.least("a", "m").alias("m"))
        # Larger neighbours take the smallest one.
        large = both.where("b > a").join(least, F.col("a") == F.col("of")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), "m")
        down = large.join(small, F.col("a") == F.col("of")).where("b <> m").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        keep = small.select(F.col("of").alias("a"), F.col("m").alias("b"))
        before, edges = edges, stored(keep.unionByName(down).where("a <> b").distinct())
        released(before)
        now = _digest(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x
