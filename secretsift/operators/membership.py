"""Membership in a small set, tested where a large table is read.

The set becomes one array of bits, made by an aggregate of its own, which the plan of
the large table holds as a scalar subquery. A row that fails the test isn't in the
set; one that passes may still be outside, so an exact join has to follow. The
array has a fixed size, however many values the set has: more values let more rows pass.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

HASHES = 5
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 23
# Bits per value that let about one row in a hundred pass by mistake.
BITS_PER_VALUE = 10
WORD = 64


def _places(value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), value), F.lit(bits)) for seed in range(HASHES)]


def bits_for(expected: int) -> int:
    """Size of the array for a number of values, a power of two between the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_VALUE * expected - 1).bit_length()))


def bit_array(values: DataFrame, column: str, expected: int) -> tuple[Column, int]:
    """The bits of the values in ``column`` as a scalar subquery, and how many there are."""
    bits = bits_for(expected)
    set_bits = values.select(F.explode(F.array(*_places(F.col(column), bits))).alias("bit"))
    word, one = F.floor(F.col("bit") / WORD).alias("word"), F.lit(1).cast("long")
    marked = set_bits.select(word, F.call_function(
        "shiftleft", one, (F.col("bit") % WORD).cast("int")).alias("bits"))
    empty = values.sparkSession.range(bits // WORD).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = marked.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    whole = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return whole.select(F.transform("words", lambda w: w["bits"]).alias("words")).scalar(), bits


def may_hold(value: Column, array: Column, bits: int) -> Column:
    """False where ``value`` is certainly not among the values of the array."""
    tests = [F.getbit(F.get(array, F.floor(at / WORD).cast("int")), (at % WORD).cast("int")) == 1
             for at in _places(value, bits)]
    return reduce(and_, tests)
