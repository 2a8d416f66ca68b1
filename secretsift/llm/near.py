"""Near-duplicate documents: MinHash bands for candidates, odd sketches to sift them, full sets to confirm.

A document's set holds the hashes of its distinct runs of ``shingle`` words, A-Z
lower-cased. Equal sets form a class, which is handled once. MinHash samples of
each class are cut into bands; classes that agree in a band are candidates. An odd
sketch folds all samples into 512 parity bits: the population count of the XOR of
two sketches tells how many samples differ, so pairs far below the threshold fall
out without touching their sets. What is left is confirmed on the sets.

No bucket is expanded into all its pairs. First its smallest class is compared with
its others; after the components of these links are known, only classes that are
not yet connected with that smallest class meet the rest of the bucket, and only
across components; the same holds for the bands after the first few. Links inside a
component cannot change it. Shingles that no other
class in these buckets has bound what two of them can share; pairs that stay
below the threshold even so are never formed. In the last step the bound counts only
shingles that more than ``RARE`` of the classes left have: classes that share a rarer
one meet by it, in a list of at most ``RARE``, and all others can share nothing else.
Both are exact and keep a large group of texts that are almost near duplicates from
being expanded. A pair that agrees in many bands is formed in the first of them only.

Two texts at similarity 0.8 agree in none of the 42 bands of 6 samples with
probability (1 - 0.8**6)**42 = 3e-6; their sketches differ in more than ``MOST_ODD``
bits with about as little.

Defined results: texts without words are linked with nothing and are their own
component; a text with fewer words than a shingle is one shingle; rows of one id
are documents of their own with that id; a null id is its own smallest only among
nulls; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from secretsift.llm.common import components, numbered, released, stored
from secretsift.llm.tokens import groups, mixed, runs, word_hashes

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 42, 6
BITS = 512
# At similarity 0.8 a sketch pair differs in 84 bits on average, with a standard
# deviation of 10 from samples and sketch.
MOST_ODD = 130
# Bands whose buckets are linked first; the others only link what these have left apart.
FIRST_BANDS = 10
# Classes left for the last step that may have a shingle, at most, for it to be a meeting point of its own.
RARE = 64

_SAMPLES = 256
_RNG = np.random.default_rng(11)
_MULTIPLY = _RNG.integers(1, 2**63, _SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 2**63, _SAMPLES, dtype=np.uint64)
_INDEX = mixed(np.arange(1, _SAMPLES + 1, dtype=np.uint64))
_PART = 4096


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, bounds = word_hashes(texts, lower=True)
    grams = runs(words, shingle)
    for start, end in zip(bounds[:-1], bounds[1:]):
        count = end - start
        if count >= shingle:
            yield np.unique(grams[start : end - shingle + 1])
        else:
            yield runs(words[start:end], count) if count else words[:0]


def minhashes(values: np.ndarray) -> np.ndarray:
    """Least value of the set under each of the sample functions."""
    least = np.full(_SAMPLES, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(values), _PART):
        part = values[i : i + _PART, None] * _MULTIPLY + _ADD
        np.minimum(least, part.min(axis=0), out=least)
    return mixed(least ^ _INDEX)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall to each bit, as 64-bit words."""
    odd = np.bincount((samples >> np.uint64(64 - 9)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.string()).fill_null("")
        for start, end in groups(texts):
            sizes, marks, bands, sketches = [], [], [], []
            for values in shingle_sets(texts.slice(start, end - start), shingle):
                sizes.append(len(values))
                marks.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                if not len(values):
                    bands.append([])
                    sketches.append([])
                    continue
                samples = minhashes(values)
                sketches.append(odd_sketch(samples))
                bands.append(runs_of(samples))
            yield pa.RecordBatch.from_arrays([
                batch.column("row_id").slice(start, end - start),
                batch.column("id").slice(start, end - start),
                pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())),
            ], names=["row_id", "id", "n_shingles", "mark", "bands", "sketch"])


def runs_of(samples: np.ndarray) -> np.ndarray:
    """One hash per band; the samples carry their position, so bands never mix."""
    used = mixed(samples[: BANDS * ROWS] * np.uint64(0x9FB21C651E98DF25))
    return np.bitwise_xor.reduce(used.reshape(BANDS, ROWS), axis=1).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.string()).fill_null("")
        for start, end in groups(texts):
            found = [v.view(np.int64) for v in shingle_sets(texts.slice(start, end - start), shingle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id").slice(start, end - start), pa.array(found, pa.list_(pa.int64()))],
                names=["node", "members"])


def _odd(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ."""
    return sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(1, BITS // 64)),
               F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))


def _pairs(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct candidate pairs (``a`` < ``b``) whose sketches are close."""
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    close = pairs.join(left, "a").join(right, "b").where(_odd(F.col("sketch_a"), F.col("sketch_b")) <= MOST_ODD)
    return close.select("a", "b")


def _members(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The full sets of ``nodes`` (distinct): ``node``, ``members``."""
    # One plan at every size: the number of ids grows with the table.
    ids = nodes.select(F.col("node").alias("row_id")).hint("merge")
    held = texts.select("row_id", "text").join(ids, "row_id", "left_semi")
    return stored(held.mapInArrow(partial(_sets, shingle=shingle), "node long, members array<long>"))


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    pairs = stored(pairs)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _members(nodes, texts, shingle)
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
    joined = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a") + F.size("set_b") - common
    links = stored(joined.where(100 * common >= percent * union).select("a", "b"))
    released(pairs, sets)
    return links


def _shareable(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Of each of ``nodes`` the size of its set and how much of it another one has: ``node``, ``n``, ``shared``."""
    sets = _members(nodes, texts, shingle)
    rows = sets.select("node", F.explode("members").alias("member"))
    alone = rows.groupBy("member").agg(F.count("*").alias("nodes"), F.min("node").alias("node")).where("nodes = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    sizes = sets.select("node", F.size("members").cast("long").alias("n"))
    out = sizes.join(alone, "node", "left")
    out = stored(out.select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared")))
    released(sets)
    return out


def _root_of(roots: DataFrame, side: str) -> DataFrame:
    return roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))


def _divided(nodes: DataFrame, texts: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Sizes and meeting points of ``nodes``.

    ``node``, ``n``, ``common`` (shingles that more than ``RARE`` of the nodes have) and
    ``rare`` (that others have, but fewer); then ``member`` and ``node`` of the rare ones.
    """
    sets = _members(nodes, texts, shingle)
    rows = sets.select("node", F.explode("members").alias("member"))
    few = rows.groupBy("member").agg(F.count("*").alias("nodes")).where(F.col("nodes") <= RARE)
    rare = stored(rows.join(few.hint("merge"), "member"))
    uncommon = rare.groupBy("node").agg(
        F.count("*").alias("uncommon"), F.count_if(F.col("nodes") > 1).alias("rare"))
    sizes = sets.select("node", F.size("members").cast("long").alias("n")).join(uncommon, "node", "left")
    sizes = stored(sizes.select("node", "n", (F.col("n") - F.coalesce("uncommon", F.lit(0))).alias("common"),
                                F.coalesce("rare", F.lit(0)).alias("rare")))
    released(sets)
    return sizes, rare.where("nodes > 1").select("member", "node")


def _side(df: DataFrame, of: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{of}") for c in df.columns])


def _close_across() -> Column:
    """Whether the sides ``a`` and ``b`` are in different components and have close sketches."""
    return (F.col("root_a") != F.col("root_b")) & (_odd(F.col("sketch_a"), F.col("sketch_b")) <= MOST_ODD)


def _across(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs inside a bucket that may be links between components by common shingles, one of them ``apart``."""
    apart, other = _side(placed.where("apart"), "a"), _side(placed, "b")
    most = F.least("common_a", "common_b")
    may = 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)
    same = F.zip_with("bands_a", "bands_b", lambda x, y: x == y)
    met = apart.join(other, (F.col("band_a") == F.col("band_b")) & may
                     & (~F.col("apart_b") | (F.col("node_a") < F.col("node_b"))) & _close_across()
                     & (F.array_position(same, True) == F.col("slot_a") + 1))
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _by_rare(held: DataFrame, percent: int) -> DataFrame:
    """Pairs with a rare ``member`` in common that may be links between components."""
    most = F.least("common_a", "common_b") + F.least("rare_a", "rare_b")
    may = 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)
    met = _side(held, "a").join(_side(held, "b"), (F.col("member_a") == F.col("member_b"))
                                & (F.col("node_a") < F.col("node_b")) & may
                                & _close_across())
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """``row_id``, ``id``, ``n_shingles`` and ``component_id`` (smallest id) of each document."""
    texts = numbered(df, key, F.col(key).alias("id"), F.col(text).alias("text"))
    return components_of(texts, shingle, percent)


def components_of(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    signed = stored(texts.mapInArrow(
        partial(_signatures, shingle=shingle),
        "row_id long, id long, n_shingles long, mark binary, bands array<long>, sketch array<long>"))
    # row_id is ordered as the ids, so the smallest row of a class or component has its smallest id.
    classes = signed.where("n_shingles > 0").groupBy("mark").agg(F.min("row_id").alias("node"))
    nodes = signed.join(classes.select("node"), signed.row_id == classes.node, "left_semi")
    nodes = stored(nodes.select(F.col("row_id").alias("node"), "bands", "sketch"))
    # Nodes that share a bucket, and of these the ones that can be similar to another one at all.
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("last"))
    meeting = banded.join(shared.where("center <> last").select("band"), "band", "left_semi")
    bounds = _shareable(stored(meeting.select("node").distinct()), texts, shingle)
    able = nodes.join(bounds.where(100 * F.col("shared") >= percent * F.col("n")), "node")
    banded = stored(able.select("node", "n", "shared", F.posexplode("bands").alias("slot", "band")))
    buckets = banded.groupBy("band").agg(
        F.min("node").alias("center"), F.max("node").alias("last"),
        F.min_by("n", "node").alias("center_n"), F.min_by("shared", "node").alias("center_shared"))
    buckets = buckets.where("center <> last")
    sketches = nodes.select("node", "sketch")

    most = F.least("shared", "center_shared")
    may = 100 * most >= percent * (F.col("n") + F.col("center_n") - most)
    met = banded.join(buckets.withColumnRenamed("band", "of"), (F.col("band") == F.col("of"))
                      & (F.col("node") != F.col("center")) & may)
    star = stored(met.select("slot", F.col("center").alias("a"), F.col("node").alias("b")))
    early = _pairs(star.where(F.col("slot") < FIRST_BANDS), sketches)
    links = _confirmed(early, texts, shingle, percent)
    roots = stored(components(links))
    # The other bands repeat most of these pairs; only those between components count.
    late = star.where(F.col("slot") >= FIRST_BANDS).select("a", "b").distinct()
    late = late.join(_root_of(roots, "a"), "a", "left").join(_root_of(roots, "b"), "b", "left").where(
        F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    links = links.unionByName(_confirmed(_pairs(late, sketches), texts, shingle, percent))

    # What a bucket's first comparison has left apart: buckets with more than one component.
    roots = stored(components(links))
    placed = banded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_ = placed.groupBy("band").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"),
        F.min_by("root", "node").alias("center_root"), F.min("node").alias("center"))
    mixed_ = mixed_.where("low <> high AND size > 2").select("band", "center", "center_root")
    placed = stored(placed.join(mixed_, "band").where("node <> center").select(
        "band", "slot", "node", "root", (F.col("root") != F.col("center_root")).alias("apart")))
    left = stored(placed.select("node", "root").distinct())
    sizes, rare = _divided(left, texts, shingle)
    able = sizes.where(100 * F.col("common") >= percent * F.col("n")).join(nodes, "node")
    apart = stored(placed.join(able, "node"))
    held = stored(rare.join(left.join(sizes, "node").join(sketches, "node"), "node"))
    met = _across(apart, percent).unionByName(_by_rare(held, percent))
    rest = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _confirmed(rest, texts, shingle, percent)
    if more.limit(1).count():
        roots = stored(components(links.unionByName(more)))
    released(nodes, banded, star, placed, left, sizes, apart, held, bounds)

    members = signed.select("row_id", "id", "n_shingles", "mark").join(classes.withColumnRenamed("mark", "of"),
                                                                     F.col("mark") == F.col("of"), "left")
    members = members.withColumn("node", F.coalesce("node", "row_id")).join(roots, "node", "left")
    members = members.withColumn("root", F.coalesce("root", "node"))
    ids = signed.select(F.col("row_id").alias("root"), F.col("id").alias("component_id"))
    return members.join(ids, "root").select("row_id", "id", "n_shingles", "component_id", (
        F.col("row_id") == F.col("root")).alias("first"))


def keep_one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                     percent: int = PERCENT) -> DataFrame:
    """``df`` with one document of each group of near duplicates: the one with the smallest id."""
    rows = numbered(df, key, F.struct("*").alias("row"))
    texts = rows.select("row_id", F.col("row")[key].cast("long").alias("id"), F.col("row")[text].alias("text"))
    later = components_of(texts, shingle, percent).where("NOT first").select("row_id")
    return rows.join(later, "row_id", "left_anti").select("row.*")
