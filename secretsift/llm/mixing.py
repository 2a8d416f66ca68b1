"""Mixing sources to target weights.

The words of each source form one stream, documents in the order of their ids,
cut into blocks of ``block`` words. The mix has a number of slots for each source; each output
shard draws how many of them it gets of every source, and the n-th slot of a
source takes the block that a pseudorandom permutation of its block indexes puts
at n. A second pass over a source uses another permutation. Slots and blocks meet
in a join by index.

The draws are multinomial: a source's slots are split over ranges of shards, those over
smaller ranges, down to single shards, each split by a generator seeded with the source
and the range. So totals meet the targets exactly, shards have about ``SHARD_SLOTS`` slots, any shard
can be drawn again by itself, and a source with many slots is split over tasks. The plan of the
sources stays in a table: the driver sees sums over ranges of sources, and neither
sources nor shards.

Defined results: null texts have no words; null is a source of its own, sorted
last; sources without words have target 0; repeated rows are documents of their
own; reruns give the same mix; an empty table gives an empty result. Input columns
travel in one struct, so their names cannot clash with those made here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pyspark.sql.types import LongType

from secretsift.llm.common import WORD, id_cuts, range_of, stored, whole

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
BLOCK = 64
SHARD_SLOTS = 4096
# Ranges that a range of shards is split into at once.
FAN_OUT = 256
# More sources than this are joined by shuffles.
BROADCAST_SOURCES, SALTS = 100_000, 16
SEED = 20


@dataclass
class Mix:
    """Stored documents, the plan of each source, and the words each slot takes."""

    docs: DataFrame  # row_id, row, id, source, size
    sources: DataFrame  # place, source, source_size, target, blocks, slots
    taken: DataFrame  # row_id, epoch, shard, slot, first, last: words [first, last) of a document


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> list[float]:
    """Words wanted of each source: by weight, at most ``most`` times its size."""
    weight = np.array([weights[i % len(weights)] for i in range(len(sizes))], dtype=float)
    size = np.array(sizes, dtype=float)
    wanted, left, open_ = np.zeros(len(size)), share * size.sum(), size > 0
    while open_.any() and left > 0:
        given = np.where(open_, left * weight / weight[open_].sum(), 0.0)
        full = open_ & (given > most * size)
        if not full.any():
            return list(np.where(open_, given, wanted))
        wanted[full] = most * size[full]
        left = share * size.sum() - wanted[~open_ | full].sum()
        open_ = open_ & ~full
    return list(wanted)


def permuted(at: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of index ``at`` in a permutation of ``size`` indexes chosen by ``key``.

    A Feistel network over an even number of bits; places beyond the size are
    mapped again until they fall inside.
    """
    at, size, key = at.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    half = np.ones(len(size), dtype=np.uint64)
    for bits in range(1, 32):
        half[size > np.uint64(1) << np.uint64(2 * bits)] = bits + 1
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = at.copy(), np.arange(len(at))
    while len(open_):
        h, m, k = half[open_], mask[open_], key[open_]
        left, right = out[open_] >> h, out[open_] & m
        for turn in range(4):
            left, right = right, left ^ (_mixed(right, k, turn) & m)
        out[open_] = (left << h) | right
        open_ = open_[out[open_] >= size[open_]]
    return out.astype(np.int64)


def _mixed(value: np.ndarray, key: np.ndarray, turn: int) -> np.ndarray:
    x = value * np.uint64(0x9E3779B97F4A7C15) + key + np.uint64((turn * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@F.pandas_udf(LongType())
def _block_at(at: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(at.to_numpy(), size.to_numpy(), key.to_numpy()))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, block: int = BLOCK,
        seed: int = SEED, keep_text: bool = True) -> Mix:
    """Plan a mix of ``df``: which words of which document every slot takes."""
    row = F.struct("*") if keep_text else F.struct("*").dropFields(text)
    docs = stored(df.select(
        F.monotonically_increasing_id().alias("row_id"), row.alias("row"), F.col(key).alias("id"),
        F.col(source).alias("source"), F.xxhash64(text).alias("tie"),
        F.regexp_count(whole(F.col(text)), F.lit(WORD)).cast("long").alias("size")))
    sources = _planned(docs, weights, share, block)
    # Both sides grow with the documents. Statistics take the slots for few, as they are exploded from a small table.
    taken = _slots(sources, seed).hint("merge").join(_fragments(_positions(docs), sources, block), ["place", "block"])
    return Mix(docs, sources, taken.select("row_id", "epoch", "shard", "slot", "first", "last"))


def _planned(docs: DataFrame, weights: tuple[int, ...], share: float, block: int, most: float = MOST) -> DataFrame:
    """The plan of each source: its place in order, target, blocks and slots.

    Targets are as in ``targets``: rounds of sums find the sources that reach ``most``.
    """
    # Code points and UTF-8 bytes sort alike; null last.
    order = F.col("source").asc_nulls_last()
    sizes = docs.groupBy("source").agg(F.sum("size").alias("size")).repartitionByRange(order)
    at = F.monotonically_increasing_id()
    ranged = stored(sizes.sortWithinPartitions(order).select(
        "source", "size", F.shiftright(at, 33).alias("range"), at.bitwiseAND((1 << 33) - 1).alias("at")))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n")).collect()
    placed = ranged.withColumn("place", _before(counts) + F.col("at"))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    placed = placed.withColumn("weight", weight)
    size, weight = F.col("size"), F.col("weight")
    filled = placed.where(size > 0)

    def sums(of: DataFrame) -> tuple[int, int]:
        row = of.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        return int(row[0]), int(row[1])

    (words, all_), full = sums(filled), (0, 0)
    left, open_ = share * words, all_
    while open_:
        now = sums(filled.where(F.lit(left) * weight / F.lit(float(open_)) > F.lit(float(most)) * size))
        if now == full:
            break
        full, left, open_ = now, share * words - most * now[0], all_ - now[1]
    given = F.lit(left) * weight / F.lit(float(open_)) if open_ else F.lit(float("inf"))
    target = F.when(size > 0, F.least(given, F.lit(float(most)) * size)).otherwise(0.0)
    plan = placed.withColumn("target", target).withColumn("blocks", F.ceil(size / block).cast("long"))
    plan = plan.withColumn("slots", F.when(size > 0, F.rint(F.col("target") / size * F.col("blocks"))).otherwise(0).cast("long"))
    return stored(plan.select(
        "place", "source", F.col("size").alias("source_size"), "target", "blocks", "slots"))


def _before(counts: list) -> Column:
    """Sum of ``n`` over the ranges below a row's ``range``."""
    starts, total = [], 0
    for r in sorted(counts, key=lambda r: r.range):
        starts.append(F.struct(F.lit(r.range).cast("long").alias("range"), F.lit(total).cast("long").alias("n")))
        total += r.n
    if not starts:
        return F.lit(0).cast("long")
    return F.get(F.filter(F.array(*starts), lambda s: s["range"] == F.col("range")), F.lit(0))["n"]


def with_plan(df: DataFrame, sources: DataFrame, *columns: str) -> DataFrame:
    """Add ``columns`` of the plan to rows with a ``source``.

    Of a plan too large to broadcast every source has a copy per salt, so the rows of
    one source are spread over tasks.
    """
    plan = sources.select(F.col("source").alias("_of"), *columns)
    match = F.col("source").eqNullSafe(F.col("_of"))
    if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return df.join(F.broadcast(plan), match).drop("_of")
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = plan.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, match & (F.col("_salt") == F.col("_copy"))).drop("_of", "_salt", "_copy")


def _positions(docs: DataFrame) -> DataFrame:
    """``start`` of each document in its source's stream.

    Sums run inside ranges of ids; the ranges of a source are summed on top of
    them, so a source of any size is spread over all tasks.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.drop("row").withColumn("range", range_of(F.col("id"), id_cuts(docs, "id", parts)))
    sums = docs.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("of"), F.col("range").alias("in_range"),
                          F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("id", "tie", "row_id").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(
        offsets.hint("merge"), placed.source.eqNullSafe(offsets.of) & (placed.range == offsets.in_range))
    return joined.select("row_id", "source", "size", (F.col("offset") + F.col("inside")).alias("start"))


def _fragments(streams: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """The piece of each block that each document holds."""
    held = with_plan(streams.where("size > 0"), sources, "place")
    end = F.col("start") + F.col("size")
    numbers = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    pieces = held.select("place", "row_id", "start", "size", F.explode(numbers).alias("block"))
    first = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    last = F.least((F.col("block") + 1) * block - F.col("start"), F.col("size"))
    return pieces.select("place", "block", "row_id", first.alias("first"), last.alias("last"))


_DRAWS = "place long, blocks long, low long, high long, first long, count long"


def split(place: int, low: int, high: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the ranges that shards ``low`` to ``high`` are split into, and how many of ``count`` slots each draws."""
    bounds = np.unique(low + (high - low) * np.arange(FAN_OUT + 1, dtype=object) // FAN_OUT).astype(np.int64)
    sizes = np.diff(bounds)
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, place, low, high])))
    return bounds, rng.multinomial(count, sizes / sizes.sum())


def _splitter(seed: int):
    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: dict[str, list[np.ndarray]] = {c: [] for c in ("place", "blocks", "low", "high", "first", "count")}
            for r in frame.itertuples(index=False):
                bounds, counts = split(r.place, r.low, r.high, r.count, seed)
                some = np.flatnonzero(counts)
                for c, values in (
                        ("place", np.full(len(some), r.place)), ("blocks", np.full(len(some), r.blocks)),
                        ("low", bounds[some]), ("high", bounds[some + 1]),
                        ("first", (r.first + np.cumsum(counts) - counts)[some]), ("count", counts[some])):
                    found[c].append(values)
            if len(frame):
                yield pd.DataFrame({c: np.concatenate(v) for c, v in found.items()})

    return draw


def _slots(sources: DataFrame, seed: int) -> DataFrame:
    """Every slot with its shard and the block it takes."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = int(sources.agg(F.sum("slots")).first()[0] or 0)
    shards = max(1, -(-total // SHARD_SLOTS))
    zero = F.lit(0).cast("long")
    draws = sources.where("slots > 0").select(
        "place", "blocks", zero.alias("low"), F.lit(shards).cast("long").alias("high"), zero.alias("first"),
        F.col("slots").alias("count"))
    width = shards
    while width > 1:
        draws = draws.repartition(parts).mapInPandas(_splitter(seed), _DRAWS)
        width = -(-width // FAN_OUT)
    at = draws.repartition(parts).select(
        "place", "blocks", F.col("low").alias("shard"),
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("slot"))
    at = at.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks")))
    block = _block_at(F.col("slot") % F.col("blocks"), F.col("blocks"),
                      F.xxhash64(F.lit(seed), F.col("place"), F.col("epoch")))
    return at.select("place", "shard", "slot", "epoch", block.alias("block"))


def mixed_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                    **settings) -> DataFrame:
    """The mix as documents: the words it takes of each, one row per pass over the source.

    A document taken whole keeps its text; of others the taken words are joined
    by a space in their order. ``n_chars`` is adjusted where there is one.
    """
    planned = mix(df, key, text, source, **settings)
    pieces = planned.taken.groupBy("row_id", "epoch").agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("pieces"),
        F.sum(F.col("last") - F.col("first")).alias("words"))
    docs = planned.docs.select("row_id", "row", "size")
    joined = docs.join(pieces.hint("merge"), "row_id")
    words = F.regexp_extract_all(F.col("row")[text], F.lit(WORD), F.lit(0))
    joined = joined.withColumn("all_words", F.when(F.col("words") < F.col("size"), words))
    parts = F.flatten(F.transform("pieces", lambda p: F.slice(
        F.col("all_words"), (p["first"] + 1).cast("int"), (p["last"] - p["first"]).cast("int"))))
    part = F.col("words") < F.col("size")
    joined = joined.withColumn("mixed", F.when(part, F.array_join(parts, " ")).otherwise(F.col("row")[text]))
    columns = {c: F.col("row")[c] for c in df.columns}
    columns[text] = F.col("mixed")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(part, F.length("mixed").cast("long")).otherwise(columns["n_chars"])
    return joined.select(*[c.alias(name) for name, c in columns.items()])
