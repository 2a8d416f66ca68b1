"""Whitening of embeddings with distributed block matrices.

Every entry becomes the integer ``floor(64 * c) + 1000000``, so equal vectors are
equal exactly and sums have no rounding. The fit list holds each integer vector once.
Its rows, centred by the exact sums, are indexed into a ``BlockMatrix``; transpose
times itself is the scatter. The driver decomposes that d x d matrix, and
one more block multiplication by the whitening matrix projects the rows. The long
dimension is split, so that every task multiplies a bounded number of blocks and
only d x d partial products are added up.

Defined results: rows whose vector is null, empty, or holds null, NaN, infinite or
absolute entries from ``LARGEST`` on (their integers would leave 64 bits) are dropped, and so
are those of another length than most remaining rows have (the longer of equally
frequent lengths). Repeated rows give repeated results,
equal vectors the same ones; null ids stay. Components whose eigenvalue is not above
``RANK`` times the largest can't be whitened and are left out, so one distinct vector
or an empty table gives an empty result. ``deviation`` is null beyond 64 bits. Other
columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from secretsift.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 1024  # rows of a block
SPLIT_BLOCKS = 8  # blocks that are multiplied in one task
RANK = 1e-12
LARGEST = 2.0**50


@dataclass
class Whitening:
    """Sums of the fit list, its components by falling eigenvalue, and how far whitening is off."""

    n: int
    sums: list[int]
    wide: str  # type that holds n times an entry
    eigenvalues: np.ndarray
    components: np.ndarray  # a column each
    trace: float
    identity_error: float


def integers(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and the integer vector ``x`` of every usable row; see the module's text."""
    c = F.col(vector)
    entry = F.transform(c, lambda v: v.cast("double"))
    usable = F.forall(entry, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    whole = F.transform(entry, lambda v: F.floor(v * SCALE).cast("long") + SHIFT)
    rows = stored(df.where(c.isNotNull() & (F.size(c) > 0)).where(usable).select(
        F.col(key).alias("id"), whole.alias("x")))
    # Lengths are few in any table that makes sense; the order takes one row to the driver.
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (length.d if length else 0))


def indexed(df: DataFrame) -> DataFrame:
    """``df``, stored, with ``index`` from 0 on without gaps.

    Rows are counted per stored part; the driver sees one number for each.
    """
    at = F.monotonically_increasing_id()
    rows = stored(df.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_at")))
    counts = sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect())
    total, before = 0, {}
    for part, count in counts:
        before[part], total = total, total + count
    if not before:
        return rows.select(*df.columns, F.col("_at").alias("index"))
    starts = F.create_map(*[F.lit(v).cast("long") for pair in before.items() for v in pair])
    return rows.select(*df.columns, (starts[F.col("_part")] + F.col("_at")).alias("index"))


def blocks(rows: DataFrame, vector: Column, width: int) -> BlockMatrix:
    """The array column ``vector`` of rows with an ``index`` as a matrix, one block wide."""
    frame = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(vector).alias("v")), "v")
    return IndexedRowMatrix(frame).toBlockMatrix(BLOCK_ROWS, width)


def times(left: BlockMatrix, right: BlockMatrix) -> BlockMatrix:
    """``left`` x ``right`` with the middle dimension split into groups of ``SPLIT_BLOCKS`` blocks."""
    splits = max(1, -(-left.numColBlocks // SPLIT_BLOCKS))
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times itself; as many rows as the matrix has columns."""
    return times(matrix.transpose(), matrix).toLocalMatrix().toArray()


def rows_of(matrix: BlockMatrix, spark) -> DataFrame:
    """``index`` and the array ``values`` of every row, without a way through Python."""
    found = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    index, vector = found.columns
    return found.select(F.col(index).alias("index"), vector_to_array(F.col(vector)).alias("values"))


def local(values: np.ndarray, spark) -> BlockMatrix:
    """A small matrix as one block."""
    dense = Matrices.dense(*values.shape, values.ravel(order="F"))
    return BlockMatrix(spark.sparkContext.parallelize([((0, 0), dense)], 1), *values.shape)


def off(sums: list[int], n: int, wide: str, then) -> Column:
    """``then`` of ``n * x - sum`` of each dimension, exact."""
    totals = F.array(*[F.lit(s).cast(wide) for s in sums])
    times_n = F.lit(n).cast("long" if wide == "long" else "decimal(18,0)")
    return F.zip_with("x", totals, lambda x, s: then(
        x.cast("long" if wide == "long" else "decimal(19,0)") * times_n - s))


def centred(sums: list[int], n: int, wide: str) -> Column:
    """``x`` less the mean: the exact difference of integers, then one division."""
    return off(sums, n, wide, lambda d: d.cast("double") / float(n))


def deviation(sums: list[int], n: int, wide: str) -> Column:
    """Sum of the squares of ``n * x - sum``, null beyond 64 bits."""
    zero = F.lit(0).cast("decimal(38,0)")
    squares = off(sums, n, wide, lambda d: _square(d.try_cast("decimal(19,0)")))
    return F.aggregate(squares, zero, lambda a, b: (a + b).try_cast("decimal(38,0)")).try_cast("long")


def _square(narrow: Column) -> Column:
    return (narrow * narrow).try_cast("decimal(38,0)")


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct ``x`` of ``rows``; None where nothing varies."""
    spark = rows.sparkSession
    # A vector that many rows share is grouped before the shuffle.
    distinct = indexed(rows.select("x").distinct())
    # One row per dimension; dimensions are as many as the vectors are long.
    sums = distinct.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(
        F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.max(F.abs("v")).alias("most"),
        F.count("*").alias("n")).orderBy("at").collect()
    if not sums or sums[0].n < 2:
        return None
    n, totals = sums[0].n, [int(r.s) for r in sums]
    # Differences of the shifted integers stay below twice n times the largest one.
    wide = "long" if n * max(r.most for r in sums) < 1 << 61 else "decimal(38,0)"
    matrix = blocks(distinct, centred(totals, n, wide), len(totals))
    v = scatter(matrix) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = int((values[:most] > RANK * max(values[0], 0)).sum())
    if not keep:
        return None
    out = Whitening(n, totals, wide, values[:keep], vectors[:, :keep], float(np.trace(v)), 0.0)
    error = scatter(matrix.multiply(local(_matrix(out), spark))) / n - np.eye(keep)
    out.identity_error = float(np.abs(error).max())
    return out


def _matrix(found: Whitening) -> np.ndarray:
    return found.components / np.sqrt(found.eigenvalues)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """``id``, ``n``, ``deviation``, the array ``whitened`` and ``explained`` per usable row of ``df``."""
    spark = df.sparkSession
    rows = integers(df, key, vector)
    found = fit(rows, most)
    if found is None:
        return rows.limit(0).select(
            "id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
            F.array().cast("array<double>").alias("whitened"), F.array().cast("array<double>").alias("explained"),
            F.lit(0.0).alias("identity_error"))
    rows = indexed(rows)
    known = found.sums, found.n, found.wide
    matrix = blocks(rows, centred(*known), len(found.sums))
    projected = rows_of(matrix.multiply(local(_matrix(found), spark)), spark)
    share = [float(e / found.trace) for e in found.eigenvalues]
    # Both sides grow with the rows, so neither is to be broadcast.
    return rows.select("index", "id", deviation(*known).alias("deviation")).join(
        projected.hint("merge"), "index").select(
        "id", F.lit(found.n).cast("long").alias("n"), "deviation", F.col("values").alias("whitened"),
        F.array(*[F.lit(s) for s in share]).alias("explained"), F.lit(found.identity_error).alias("identity_error"))


def by_component(whitened: DataFrame) -> DataFrame:
    """One row per row and component, numbered from 1."""
    numbered = whitened.select("id", "n", "deviation", "identity_error",
                               F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"))
    return numbered.select("id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
                           F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error")
