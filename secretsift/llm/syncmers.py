"""Document fingerprints from closed syncmers, in Spark SQL functions only.

A text is a sequence of symbols, its code points, between end marks. Of its runs of
``K`` symbols those are anchors whose least inner run of ``S`` symbols is the first or
the last of them. Whether a run is an anchor depends on nothing outside it, and texts
of every length and script are read alike, so an edit changes only the anchors that
touch it, and equal passages carry equal anchors at equal distances. So the anchors of an edited
text are put together from those of the texts it was made of; only the runs across
the seam and at the end are read anew.

Anchors match by position: the fingerprint lists, in text order, a hash of each anchor and
its distance to the next one, and likeness is the share of such pairs that two texts
have in common. For that, a repeated pair is told from its earlier occurrences by their number.

Defined results: a null text counts as empty; ``K - 1`` end marks on either side give
texts with fewer symbols than a run anchors too, and the empty text has none; two
texts without anchors have likeness 1. Equal texts have equal fingerprints. In the
order of documents null ids come first, rows of one id are ordered by the hash of
their text (repeated rows are documents of their own), and a single document is its own
successor. An empty table gives an empty result. Only the key and the text are read
and columns made here begin with ``_``, so other columns of the input cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from secretsift.functions.text import let
from secretsift.llm.common import id_cuts, range_of, whole

K, S = 12, 4
# A symbol takes four bytes; the end mark is no code point.
WIDTH, END = 4, b"\xff" * 4
_LOW = 0xFFFFFFFF


def symbols(text: Column) -> Column:
    """A text's code points between end marks, ``WIDTH`` bytes each."""
    ends = F.lit(END * (K - 1))
    return F.when(F.length(text) > 0, F.concat(ends, F.encode(text, "UTF-32"), ends)).otherwise(F.lit(b""))


def _run(marked: Column, at: Column, length: int) -> Column:
    return F.hash(F.substring(marked, at * WIDTH + 1, F.lit(length * WIDTH)))


def _inner(marked: Column) -> Column:
    """Hashes of all runs of ``S`` symbols."""
    return F.transform(F.sequence(F.lit(0), (F.length(marked) / WIDTH).cast("int") - S), lambda at: _run(marked, at, S))


def _starts(inner: Column) -> Column:
    """Places of the anchors, from the hashes of the inner runs.

    The least of the nine inner runs of a run is the least of three leasts of three.
    """
    three = F.transform(inner, lambda x, i: F.least(x, F.get(inner, i + 1), F.get(inner, i + 2)))

    def closed(least: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(inner) - (K - S + 1)), lambda at: F.least(
            F.get(least, at), F.get(least, at + 3), F.get(least, at + 6)) == F.least(F.get(inner, at), F.get(inner, at + (K - S))))

    return let(three, closed)


def anchors(marked: Column, first: Column | None = None) -> Column:
    """The anchors of ``marked`` symbols in order, each ``place << 32 | hash``; places count from ``first``."""
    base = F.lit(0) if first is None else first

    def packed(of: Column, at: Column) -> Column:
        return F.shiftleft((at + base).cast("long"), 32).bitwiseOR(_run(of, at, K).cast("long").bitwiseAND(_LOW))

    # A lambda's argument is not copied out of the row at each use, as a column is.
    found = let(marked, lambda of: F.transform(let(_inner(of), _starts), lambda at: packed(of, at)))
    return F.when(F.length(marked) >= K * WIDTH, found).otherwise(F.array().cast("array<long>"))


def _place(anchor: Column) -> Column:
    return F.shiftright(anchor, 32).cast("int")


def edited_anchors(found: Column, next_found: Column, edited: Column, kept: Column, added: Column) -> Column:
    """Anchors of a text's first ``kept`` symbols followed by the first ``added`` of the next text.

    A run ends at its place, so one at a place below ``kept`` lies in the first text, and one
    that ends inside the added symbols and begins there too lies in the next.
    """
    before, whole_ = K - 1, kept + added
    own = F.filter(found, lambda a: _place(a) < kept)
    theirs = F.transform(
        F.filter(next_found, lambda a: (_place(a) >= before) & (_place(a) < added)),
        lambda a: a + F.shiftleft(kept.cast("long"), 32))
    # The runs that end at the places from ``kept`` on read ``K - 1`` symbols before and after.
    head, tail = F.least(kept, F.lit(before)), F.least(added, F.lit(before))
    seam = F.concat(
        _marks(before - head), F.encode(F.substring(edited, kept - head + 1, head + tail), "UTF-32"), _marks(before - tail))
    end = F.concat(F.encode(F.substring(edited, whole_ - tail + 1, tail), "UTF-32"), _marks(F.lit(before)))
    last = F.greatest(whole_, kept + before)
    return F.when(whole_ > 0, F.concat(own, anchors(seam, kept), theirs, anchors(end, last))).otherwise(
        F.array().cast("array<long>"))


def _marks(count: Column) -> Column:
    return F.substring(F.lit(END * (K - 1)), F.lit(1), count * WIDTH)


def linked(found: Column) -> Column:
    """A hash of each anchor and its distance to the next one; of the last one, alone."""
    return let(found, lambda all_: F.transform(all_, lambda a, i: F.hash(
        a.bitwiseAND(_LOW), F.coalesce(_place(F.get(all_, i + 1)) - _place(a), F.lit(0)))))


def bag(pairs: Column) -> Column:
    """The values of an array, every repetition told from the ones before it, in an order of their own."""

    def value(ranked: Column, i: Column) -> Column:
        return F.shiftright(F.get(ranked, i), 32).cast("int")

    def by_runs(ranked: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(ranked) - 1), lambda i: (i == 0) | (
            value(ranked, i) != value(ranked, F.greatest(i - 1, F.lit(0)))))
        return let(heads, lambda starts: F.flatten(F.transform(starts, lambda start, k: F.transform(
            F.sequence(start, F.coalesce(F.get(starts, k + 1), F.size(ranked)) - 1),
            lambda i: F.when(i == start, value(ranked, i)).otherwise(F.hash(value(ranked, i), i - start))))))

    placed = F.sort_array(F.transform(pairs, lambda h, i: F.shiftleft(h.cast("long"), 32).bitwiseOR(i.cast("long"))))
    return F.when(F.size(F.array_distinct(pairs)) == F.size(pairs), pairs).otherwise(let(placed, by_runs))


def fingerprint(pairs: Column) -> Column:
    """The pairs as text, in order."""
    return F.array_join(pairs.cast("array<string>"), ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of the pairs in two bags that both have, 0 to 1."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def with_next(df: DataFrame, key: str, columns: list[str], parts: int, tie: Column,
              derive: Callable[[DataFrame], DataFrame] = lambda dealt: dealt) -> DataFrame:
    """Add struct ``next`` with ``columns`` of the following row by ``key``; the last is followed by the first.

    Rows are dealt into ranges of ``key``. The first row of every range is also
    sent to the range before it, so each range finds all successors alone and
    the rows are moved once. ``derive`` adds columns to the rows after they are moved.
    """
    cuts = id_cuts(df.select(key), key, parts)
    value = F.col(key)
    ranged = df.withColumn("_range", range_of(value, cuts)).withColumn("_tie", tie)
    # Nulls come first, in a range of their own where there are any.
    nulls = df.where(value.isNull()).limit(1).count() > 0
    lowest, highest = (0 if nulls else 1), len(cuts)
    opens = F.when(F.col("_range") == 0, value.isNull()).otherwise(
        value == F.get(F.array(*[F.lit(c).cast("long") for c in cuts]), F.col("_range") - 1)
        if cuts else F.lit(False))
    before = F.when(F.col("_range") == lowest, highest).otherwise(F.col("_range") - 1)
    own = F.struct(F.col("_range").alias("_to"), F.lit(0).alias("_guest"))
    guest = F.struct(before.alias("_to"), F.lit(1).alias("_guest"))
    sent = ranged.withColumn("_sent", F.explode(F.when(opens, F.array(own, guest)).otherwise(F.array(own))))
    # Rows stay spread over tasks, as what is derived may cost much more than they are large.
    sent = derive(sent.select("*", "_sent.*").drop("_sent").repartition(max(1, parts // 4), "_to"))
    order = Window.partitionBy("_to").orderBy("_guest", value.asc_nulls_first(), "_tie")
    # Where one range is all there is, its last row is followed by its first.
    follow = F.lead(F.struct(*columns)).over(order)
    return sent.withColumn("next", follow).where("_guest = 0").drop("_range", "_tie", "_to", "_guest")


def edited_neighbours(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with its edited text, the pairs of both, and the bags of both and its successor.

    The edit replaces the last quarter of the code points by the first as many of
    the next document.
    """
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = df.select(key, whole(F.col(text)).alias("_body"))

    def derive(dealt: DataFrame) -> DataFrame:
        marked = dealt.withColumn("_symbols", symbols(F.col("_body")))
        found = marked.withColumn("_anchors", anchors(F.col("_symbols"))).drop("_symbols")
        return found.withColumn("pairs", linked(F.col("_anchors"))).withColumn("bag", bag(F.col("pairs")))

    followed = with_next(base, key, ["_body", "_anchors", "bag"], parts, F.xxhash64("_body"), derive)
    n = F.length("_body")
    quarter = F.floor(n / 4).cast("int")
    step = followed.select(
        F.col(key).alias("doc_id"), "pairs", "bag", F.col("next.bag").alias("next_bag"), "_anchors",
        F.col("next._anchors").alias("_next"), n.cast("long").alias("n_chars"),
        (n - quarter).alias("_kept"), F.least(quarter, F.length("next._body")).alias("_added"),
        F.concat(F.substring(F.col("_body"), F.lit(1), n - quarter),
                 F.substring(F.col("next._body"), F.lit(1), quarter)).alias("edited"))
    step = step.withColumn("_edit", edited_anchors(*map(F.col, ("_anchors", "_next", "edited", "_kept", "_added"))))
    step = step.withColumn("edited_pairs", linked(F.col("_edit"))).withColumn("edited_bag", bag(F.col("edited_pairs")))
    return step.drop("_anchors", "_next", "_edit", "_kept", "_added")
