"""Line deduplication with levelled sorted runs of line hashes.

A line counts by its key: white space stripped at both ends, A-Z lower-cased.
Keys of at least ``min_chars`` code points found in at least ``min_docs``
documents are frequent; only the document with the largest id that holds one
keeps its lines. Documents are taken in batches from the largest ids down. Each
batch's frequent keys are anti-joined with the runs written so far; what is new
becomes a sorted run of level 0, together with the id that keeps it, and a level
that is full is merged into one run of the next.

Defined results: a null or empty text is one empty line; a null id is smaller
than any other; repeated rows count as one document per id and text, and rows of
one id keep or lose a line together; an empty table gives an empty result. Keys
are compared by two 64-bit hashes. Input columns travel in one struct, so their
names cannot clash with those made here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from secretsift.llm.common import ascii_lower, id_cuts, range_of, released, stored, whole

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES = 4
FANOUT = 2

STRIPPED = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(STRIPPED)))


class LineRuns:
    """Keys seen so far and the id that keeps each, in levels of sorted runs."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def table(self) -> DataFrame:
        """All keys with their keeping id; a key is in one run only."""
        runs = self.runs() or [self.spark.createDataFrame([], "h1 long, h2 long, keeper long")]
        return reduce(DataFrame.unionByName, runs)

    def absorb(self, batch: DataFrame, key: str = "doc_id") -> DataFrame:
        """Add the keys of ``batch`` (``h1``, ``h2``, ``key``) that no run has, and return them."""
        fresh = batch.groupBy(*KEY).agg(F.max(key).alias("keeper"))
        for run in self.runs():
            fresh = fresh.join(run, KEY, "left_anti")
        run = stored(fresh.sortWithinPartitions(*KEY))
        self.levels[0].append(run)
        self._compact()
        return run

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = reduce(DataFrame.unionByName, self.levels[level])
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            merged = stored(merged.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY))
            released(*self.levels[level])
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1


def _parts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each document with its identity and its text; an id may come with several texts."""
    body = whole(F.col(text))
    return df.select(F.struct("*").alias("row"), F.col(key).alias("id"), body.alias("body"),
                     F.xxhash64(body).alias("body_hash"))


def dropped_lines(docs: DataFrame, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """Positions of the lines each document loses: ``id``, ``body_hash``, ``gone``."""
    keys = F.transform(F.split("body", "\n"), line_key)
    lines = docs.select("id", "body_hash", F.posexplode(keys).alias("at", "line"))
    lines = lines.where(F.length("line") >= min_chars)
    lines = stored(lines.select(
        "id", "body_hash", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))
    held = lines.groupBy(*KEY, "id").agg(F.lit(1).alias("one"))
    frequent = held.groupBy(*KEY).agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select(*KEY)
    every, held = lines, stored(lines.join(frequent, KEY).select("id", "body_hash", "at", *KEY))
    released(every)
    cuts = id_cuts(held, "id", batches)
    ranged = held.withColumn("range", range_of(F.col("id"), cuts))
    runs = LineRuns(docs.sparkSession)
    for batch in range(len(cuts), -1, -1):
        runs.absorb(ranged.where(F.col("range") == batch).select(*KEY, "id"), "id")
    lost = held.join(runs.table(), KEY).where(~F.col("id").eqNullSafe(F.col("keeper")))
    # Repeated rows list a position more than once; one document's lines bound the set.
    gone = stored(lost.groupBy("id", "body_hash").agg(F.collect_set("at").alias("gone")))
    released(held, *runs.runs())
    return gone


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``row`` of each document, its ``n_lines``, ``n_dropped`` and the text ``kept``."""
    docs = _parts(df, key, text)
    gone = dropped_lines(docs, min_chars, min_docs, batches)
    lost = gone.select(F.col("id").alias("lost_id"), F.col("body_hash").alias("lost_hash"), "gone")
    joined = docs.join(
        lost, docs.id.eqNullSafe(lost.lost_id) & (docs.body_hash == lost.lost_hash), "left")
    lines = F.split("body", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(F.col("lines")) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("body")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    return joined.withColumn("lines", lines).select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )


def drop_frequent_lines(df: DataFrame, key: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """``df`` with the lines dropped from its texts, and ``n_chars`` adjusted where it has one.

    A document that loses no line is as it was, a null text included.
    """
    out = dedup_lines(df, key, text, **limits)
    row, cut = F.col("row"), F.col("n_dropped") > 0
    columns = {c: row[c] for c in df.columns}
    columns[text] = F.when(cut, F.col("kept")).otherwise(row[text])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(cut, F.length("kept").cast("long")).otherwise(row["n_chars"])
    return out.select(*[c.alias(name) for name, c in columns.items()])
