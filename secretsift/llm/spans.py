"""Substring deduplication over a compacted De Bruijn graph of word runs.

Every run of ``window`` consecutive words is an edge between the shorter runs it
starts and ends with. Only repeated edges matter. To find them without moving every
run, each run is represented by the least of its inner runs of ``ANCHOR`` words; equal
runs have equal representatives, so only runs whose representative occurs twice are
looked at in full.

Texts that are equal as a whole are found first; only the first of them goes further.
Edges are counted by hash. Where all documents that hold an edge continue with the
same next edge, and that edge occurs nowhere else, the two lie on one nonbranching
path; joining every edge with its successor finds these links, and the places of
the path in its first document give its length. A path is then handled by its first
edge: each later document that holds it carries all of it at that place. A second
hash at the place in the first document confirms each occurrence.

A word is removed if a run that covers it occurs earlier (in a smaller id, or
earlier in the same document).

Defined results: a null text has no words; rows of one id are documents of their
own, in a fixed order, nulls first; a text of fewer words than a run is unchanged;
an empty table gives an empty result. Runs are equal if their 64-bit hashes are,
confirmed by 32 more bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from secretsift.llm.common import numbered, released, stored
from secretsift.llm.tokens import groups, mixed, runs, word_hashes

WINDOW = 20
ANCHOR = 6
_INNER = WINDOW - ANCHOR + 1
# End of the span of a whole text.
WHOLE = 2**31 - 1


def _representatives(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one text: hashes of its anchors, and for each window the place of its least one."""
    inner = runs(words, ANCHOR)
    # The high bits order, the place settles ties inside a window by the later one.
    views = np.lib.stride_tricks.sliding_window_view(inner, _INNER)
    return inner, np.arange(len(views)) + _INNER - 1 - np.argmin(views[:, ::-1], axis=1)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        texts = batch.column("text").cast(pa.string()).fill_null("")
        for start, end in groups(texts):
            words, bounds = word_hashes(texts.slice(start, end - start))
            yield batch.slice(start, end - start), words, bounds


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors that represent some window, with their places."""
    for part, words, bounds in _grouped(batches):
        ids, rows, found, places = part.column("row_id").to_numpy(zero_copy_only=False), [], [], []
        for i, (start, end) in enumerate(zip(bounds[:-1], bounds[1:])):
            if end - start >= WINDOW:
                inner, least = _representatives(words[start:end])
                at = np.unique(least)
                rows.append(np.full(len(at), ids[i]))
                found.append(inner[at])
                places.append(at)
        if rows:
            yield pa.RecordBatch.from_arrays([
                np.concatenate(found).view(np.int64), np.concatenate(rows).astype(np.int64),
                np.concatenate(places).astype(np.int32)], names=["anchor", "row_id", "at"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows whose representative is repeated.

    ``again`` marks those that the same document has had before; ``next`` is the
    hash of the window one word later if that is an edge seen for the first time.
    """
    for part, words, bounds in _grouped(batches):
        ids = part.column("row_id").to_numpy(zero_copy_only=False)
        repeated = part.column("anchors")
        columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
        for i, (start, end) in enumerate(zip(bounds[:-1], bounds[1:])):
            _, least = _representatives(words[start:end])
            flags = np.zeros(end - start, dtype=bool)
            flags[repeated[i].values.to_numpy(zero_copy_only=False)] = True
            at = np.flatnonzero(flags[least])
            windows = runs(words[start:end], WINDOW)
            hashes = windows[at]
            first = np.zeros(len(at), dtype=bool)
            first[np.unique(hashes, return_index=True)[1]] = True
            follows = np.zeros(len(at), dtype=np.int64)
            joined = np.flatnonzero((np.diff(at) == 1) & first[1:])
            follows[joined] = hashes.view(np.int64)[joined + 1]
            check = runs(mixed(words[start:end]), WINDOW)[at] >> np.uint64(32)
            for column, values in zip(columns, (
                    hashes.view(np.int64), np.full(len(at), ids[i], dtype=np.int64), at.astype(np.int32),
                    check.astype(np.uint32).view(np.int32), follows, ~first)):
                column.append(values)
        if columns[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in columns],
                names=["edge", "row_id", "at", "check", "next", "again"])


def copies(texts: DataFrame) -> DataFrame:
    """Rows whose whole text an earlier row has: ``row_id`` and the first row, ``source``."""
    marked = texts.select("row_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    groups = marked.groupBy("h1", "h2").agg(F.min("row_id").alias("source"), F.max("row_id").alias("last"))
    return marked.join(groups.where("source <> last"), ["h1", "h2"]).where("row_id <> source").select("row_id", "source")


def repeated_edges(texts: DataFrame, skipped: DataFrame) -> DataFrame:
    """Windows that may be repeated: ``edge``, ``row_id``, ``at``, ``check``, ``next``, ``again``.

    Rows in ``skipped`` are left out.
    """
    anchors = texts.mapInArrow(_anchors, "anchor long, row_id long, at int")
    anchors = stored(anchors.join(skipped.select("row_id"), "row_id", "left_anti"))
    twice = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    held = anchors.join(twice, "anchor").groupBy("row_id").agg(F.collect_list("at").alias("anchors"))
    edges = stored(texts.join(held, "row_id").mapInArrow(
        _edges, "edge long, row_id long, at int, check int, next long, again boolean"))
    released(anchors)
    return edges


def compacted_paths(edges: DataFrame) -> DataFrame:
    """Nonbranching paths of repeated edges: the first ``edge``, their number ``length``, and where they first occur."""
    graph = stored(edges.where("NOT again").groupBy("edge").agg(
        F.count("*").alias("docs"), F.min("row_id").alias("source"),
        F.min("next").alias("low"), F.max("next").alias("high"),
    ).where("docs > 1"))
    after = graph.select(F.col("edge").alias("low"), F.col("docs").alias("docs_after"))
    links = graph.where("low = high AND low <> 0").join(after, "low").where("docs = docs_after")
    inner = links.select(F.col("low").alias("edge"), F.lit(True).alias("linked"))
    flagged = graph.select("edge", "source").join(inner, "edge", "left")
    # Along a path the first occurrences are consecutive places of one document.
    placed = edges.where("NOT again").select("edge", "row_id", "at", "check").join(
        flagged.withColumnRenamed("edge", "of"), (F.col("edge") == F.col("of")) & (F.col("row_id") == F.col("source")))
    order = Window.partitionBy("source").orderBy("at")
    starts = F.count(F.when(F.col("linked").isNull(), 1)).over(order)
    paths = placed.withColumn("path", starts).groupBy("source", "path").agg(
        F.min("at").alias("source_at"), F.count("*").alias("length"),
        F.max(F.when(F.col("linked").isNull(), F.col("edge"))).alias("edge"),
        F.max(F.when(F.col("linked").isNull(), F.col("check"))).alias("source_check"))
    out = stored(paths.select("edge", "length", "source", "source_at", "source_check"))
    released(graph)
    return out


def repeated_spans(texts: DataFrame) -> DataFrame:
    """Word spans of each text that occur earlier: ``row_id``, ``first``, ``last`` (exclusive), source place."""
    same = stored(copies(texts))
    edges = repeated_edges(texts, same)
    paths = compacted_paths(edges)
    heads = edges.where("NOT again").join(paths.withColumnRenamed("edge", "of"), F.col("edge") == F.col("of")).where(
        (F.col("row_id") > F.col("source")) & (F.col("check") == F.col("source_check")))
    spans = heads.select("row_id", F.col("at").alias("first"), (F.col("at") + F.col("length") - 1 + WINDOW).alias("last"),
                         "source", "source_at")
    own = edges.where("again").select("row_id", F.col("at").alias("first"), (F.col("at") + WINDOW).cast("long").alias("last"),
                                      F.col("row_id").alias("source"), F.lit(None).cast("int").alias("source_at"))
    equal = same.select("row_id", F.lit(0).alias("first"), F.lit(WHOLE).cast("long").alias("last"), "source",
                        F.lit(0).alias("source_at"))
    found = stored(spans.unionByName(own).unionByName(equal))
    released(same, edges, paths)
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, kept = [], [], []
        for text, firsts, lasts in zip(batch.column("text"), batch.column("firsts"), batch.column("lasts")):
            words = (text.as_py() or "").encode().split()
            counts.append(len(words))
            # A copy of a text too short for a window is whole already.
            if firsts.is_valid and len(words) >= WINDOW:
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, firsts.values.to_numpy(zero_copy_only=False), 1)
                ends = np.minimum(lasts.values.to_numpy(zero_copy_only=False), len(words))
                np.add.at(change, ends, -1)
                words = [w for w, c in zip(words, np.cumsum(change)) if not c]
            removed.append(counts[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([
            batch.column("row_id"), batch.column("id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
            pa.array(kept, pa.string())], names=["row_id", "id", "n_words", "n_removed", "kept"])


def dedup_substrings(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row_id``, ``id``, ``n_words``, ``n_removed`` and the ``kept`` words of each document."""
    texts = numbered(df, key, F.col(key).alias("id"), F.col(text).alias("text"))
    spans = repeated_spans(texts.select("row_id", "text")).groupBy("row_id").agg(
        F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))
    return texts.join(spans, "row_id", "left").mapInArrow(
        _cut, "row_id long, id long, n_words long, n_removed long, kept string")
