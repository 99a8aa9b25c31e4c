"""Whitening of embeddings by a tiled covariance.

1. sums(): rows and per-dimension sums of x = floor(1024 * c) + 100000, in integers; one partial row per task and dimension.
2. column_blocks(): each Arrow batch is a row block; its centred values are cut into column blocks of TILE dimensions.
3. tiles(): dimension pairs are cut into tile keys (i, j), i <= j. Column blocks are shuffled by their row block, each tile's
   two blocks of a row block are multiplied, and the products summed per tile. A row block has as many pairs of column
   blocks as there are tiles, whatever the number of rows.
4. The tiles, MOST_DIMENSIONS squared numbers at most, are assembled and eigendecomposed on the driver.
5. Rows are projected in batches; the projections' own covariance is worked out from them in DataFrame functions.

Centring is exact: n * x - S is an integer. Rows whose vector is null or holds null or non-finite entries take no part; the
others each count, repeated ones too, whatever their vec_id (null as well). All vectors must have the same length, MOST_DIMENSIONS at
most, else it is an error. Components whose eigenvalue is within rounding of 0 (less than 1e-12 of the largest) can't be scaled to
unit variance and aren't returned: no rows come of one row, of equal rows, of empty vectors, or of none. A deviation, or a
sum, that doesn't fit in a long is an error. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import dropped, kept, prepare, shared_dir

COMPONENTS, TILE = 8, 16
SCALE, SHIFT = 1024, 100_000
#: The covariance of so many dimensions is 128 MB on the driver.
MOST_DIMENSIONS = 4096
#: Eigenvalues below this share of the largest count as 0.
NOISE = 1e-12


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, x (array of long) of the rows whose vector is whole and finite."""
    e = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(e, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))), F.lit(False))  # NaN is above all
    return rows.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def matrix(column: pa.Array, dimensions: int | None = None) -> np.ndarray:
    """The rows of a batch's list column; they must be equally long."""
    lengths = set(column.value_lengths().to_pylist())
    if len(lengths) > 1 or dimensions is not None and lengths - {dimensions}:
        raise ValueError(f"vectors differ in length: {sorted(lengths | ({dimensions} if dimensions is not None else set()))[:4]}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(x: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                m = matrix(b.column(0), None if total is None else len(total))
                n, total = n + len(m), m.sum(0) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_pydict({"dims": [len(total)] * (len(total) + 1), "dim": np.arange(-1, len(total)), "total": np.concatenate([[n], total]).astype("int64")})

    found = x.select("x").mapInArrow(run, "dims long, dim long, total long").groupBy("dims", "dim").agg(F.sum("total").alias("total"))
    widest = found.agg(F.min("dims").alias("a"), F.max("dims").alias("b")).first()
    if widest["a"] is None:
        return 0, np.zeros(0, "int64")
    if widest["a"] != widest["b"] or widest["b"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors must have one length, {MOST_DIMENSIONS} at most: {widest['a']}, {widest['b']}")
    got = {r["dim"]: r["total"] for r in found.collect()}  # a row per dimension
    return got[-1], np.array([got[d] for d in range(widest["b"])], "int64")


def centred(m: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - S of each row, exact."""
    if len(m) and int(np.abs(m).max(initial=0)) * n + int(np.abs(total).max(initial=0)) >= 1 << 63:
        raise OverflowError("n * x - S doesn't fit in a long")
    return m * n - total


def column_blocks(x: DataFrame, n: int, total: np.ndarray, tile: int) -> DataFrame:
    """row_block, col_block, values (double, row by row) of each batch's centred vectors."""
    dimensions = len(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, b in enumerate(batches):
            v = centred(matrix(b.column(0), dimensions), n, total) / n
            at = range(0, dimensions, tile)
            yield pa.RecordBatch.from_pydict({"row_block": [first + k] * len(at), "col_block": pa.array(range(len(at)), pa.int32()), "values": [np.ascontiguousarray(v[:, i : i + tile]).tobytes() for i in at]})

    return x.select("x").mapInArrow(run, "row_block long, col_block int, values binary")


def tiles(blocks: DataFrame, dimensions: int, tile: int) -> DataFrame:
    """i, j, values of each tile of the sum of products, values row by row."""
    width = [min(tile, dimensions - at) for at in range(0, dimensions, tile)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[int, int], np.ndarray] = {}  # a task's sums: a tile each
        for b in batches:
            for i, j, p, q in zip(*(b.column(k).to_pylist() for k in range(4))):
                product = np.frombuffer(p).reshape(-1, width[i]).T @ np.frombuffer(q).reshape(-1, width[j])
                done[i, j] = done[i, j] + product if (i, j) in done else product
        keys = sorted(done)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([done[k].ravel() for k in keys], pa.list_(pa.float64()))], names=["i", "j", "values"])

    a = blocks.select("row_block", F.col("col_block").alias("i"), F.col("values").alias("p")).hint("shuffle_hash")
    b = blocks.select("row_block", F.col("col_block").alias("j"), F.col("values").alias("q"))
    pairs = a.join(b, "row_block").filter("i <= j").select("i", "j", "p", "q")
    parts = pairs.mapInArrow(multiply, "i int, j int, values array<double>")
    each = parts.select("i", "j", F.posexplode("values").alias("at", "v")).groupBy("i", "j", "at").agg(F.sum("v").alias("v"))
    return each.groupBy("i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("values"))


def components(found: DataFrame, n: int, dimensions: int, tile: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (rows) by falling eigenvalue, their eigenvalues, the covariance's trace. The largest entry of each is positive."""
    cov = np.zeros((dimensions, dimensions))
    for r in found.collect():  # MOST_DIMENSIONS squared numbers at most
        i, j = r["i"] * tile, r["j"] * tile
        block = np.array(r["values"]).reshape(min(tile, dimensions - i), -1) / n
        cov[i : i + block.shape[0], j : j + block.shape[1]] = block
        cov[j : j + block.shape[1], i : i + block.shape[0]] = block.T
    values, rows = np.linalg.eigh(cov)
    values, rows = values[::-1][:most], rows.T[::-1][:most]
    use = values > max(NOISE * values.max(initial=0.0), 0.0)
    values, rows = values[use], rows[use]
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)]) if len(rows) else np.zeros(0)
    return rows * signs[:, None], values, float(np.trace(cov))


def projected(x: DataFrame, n: int, total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> DataFrame:
    """vec_id, deviation, w: the whitened components of each vector."""
    scaled, dimensions = (rows / np.sqrt(values)[:, None]).T, len(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = centred(matrix(b.column(1), dimensions), n, total)
            if len(y) and int(np.abs(y).max()) ** 2 * dimensions >= 1 << 63:  # then, and only then, may a sum be too large
                deviation = [sum(v * v for v in r) for r in y.tolist()]
            else:
                deviation = (y * y).sum(1)
            w = (y / n) @ scaled
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64()), pa.FixedSizeListArray.from_arrays(w.ravel(), w.shape[1]).cast(pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

    return x.mapInArrow(run, "vec_id long, deviation long, w array<double>")


def identity_error(w: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of w's covariance minus the identity; w is centred before it is multiplied."""
    means = w.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    at = lambda i: F.col("w")[i] - F.lit(means[i])
    sums_ = w.agg(*[F.abs(F.sum(at(i) * at(j)) / n - float(i == j)).alias(f"e{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return max(sums_)


def whitened(rows: DataFrame, most: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each vector and component of rows (vec_id, embedding)."""
    spark = rows.sparkSession
    prepare(spark)
    under = shared_dir(spark, "whitening")
    x = vectors(rows)
    n, total = sums(x)
    empty = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not n or not len(total):
        return empty
    blocks = kept(column_blocks(x, n, total, tile), "blocks", under)
    vectors_, values, trace = components(tiles(blocks, len(total), tile), n, len(total), tile, most)
    if not len(values):
        dropped(spark, under)
        return empty
    w = kept(projected(x, n, total, vectors_, values), "whitened")
    dropped(spark, under)
    error = identity_error(w, n, len(values))
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    out = w.select("vec_id", "deviation", F.posexplode("w").alias("c", "whitened"))
    return out.select("vec_id", (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, "c").alias("explained"), F.lit(error).alias("identity_error"))
