"""Exact top-k inner products by block-at-a-time pruning.

Rows in id order form blocks; a block keeps its forward index (the integer matrix) and each term's
largest and smallest value. For a query, the sum over terms of the larger of q*max and q*min bounds
every score in a block. Blocks are scored in falling order of that bound until it is below the
query's kth score, or below its floor: the kth score among SEEDS candidates that every query meets
first, so that no shard starts without one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import prepare

SCALE = 256
#: Rows of a block, blocks of a shard (what one task holds at once) and queries that meet it together.
BLOCK, SHARD_BLOCKS, CHUNK = 256, 16, 4096
#: Rows (the least by a hash of their ids) whose scores give each query its floor.
SEEDS = 1024
#: Sums of products below this are exact in float64.
EXACT = float(1 << 53)


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, terms: floor(scale * x) of each component; rows that are null or hold null or non-finite ones are left out."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return rows.filter(finite).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("terms"))


def matrix(terms: list, width: int) -> np.ndarray:
    """Rows of terms as a matrix; shorter rows end in zeros."""
    m = np.zeros((len(terms), width))
    for i, t in enumerate(terms):
        m[i, : len(t)] = t
    return m


def blocks(rows: DataFrame) -> DataFrame:
    """block (random but lasting), ids, width, data, top, low of each run of BLOCK rows in id order."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        terms: list[list[float]] = []

        def out(n: int) -> pa.RecordBatch:
            m = matrix(terms[:n], max((len(t) for t in terms[:n]), default=0))
            r = pa.RecordBatch.from_pydict({"ids": [np.array(ids[:n], np.int64).tobytes()], "width": [m.shape[1]], "data": [m.tobytes()], "top": [m.max(0).tobytes() if m.size else b""], "low": [m.min(0).tobytes() if m.size else b""]}, pa.schema([("ids", pa.binary()), ("width", pa.int32()), ("data", pa.binary()), ("top", pa.binary()), ("low", pa.binary())]))
            del ids[:n], terms[:n]
            return r

        for b in batches:
            ids += b.column(0).to_pylist()
            terms += b.column(1).to_pylist()
            while len(ids) >= BLOCK:
                yield out(BLOCK)
        if ids:
            yield out(len(ids))

    return rows.sortWithinPartitions("vec_id").mapInArrow(build, "ids binary, width int, data binary, top binary, low binary")


def products(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of rows and q, exactly; beyond 53 bits by Python's integers."""
    w = min(m.shape[1], len(q))
    m, q = m[:, :w], q[:w]
    if not w or np.abs(m).max(initial=0) * np.abs(q).max(initial=0) * w < EXACT:
        return (m @ q).astype(np.int64) if w else np.zeros(len(m), np.int64)
    y = [int(x) for x in q]
    return np.array([sum(int(a) * b for a, b in zip(row, y)) for row in m], object)


def best(query_id: int, q: np.ndarray, shard: list[tuple], k: int, floor: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, vec_id) of the shard's blocks, ties to the smaller id, and how many blocks were scored.

    floor: k candidates anywhere score so much; blocks that can't reach it are left out.
    """
    bounds = []
    for i, (_, m, top, low) in enumerate(shard):
        w = min(m.shape[1], len(q))
        bounds.append((float(np.maximum(q[:w] * top[:w], q[:w] * low[:w]).sum()), i))
    found: list[tuple[int, int]] = []
    scored = 0
    for bound, i in sorted(bounds, reverse=True):
        if bound * (1 + 1e-9 * np.sign(bound)) < max(floor, found[-1][0] if len(found) == k else -np.inf):
            break
        ids, m, _, _ = shard[i]
        s = products(m, q)
        scored += 1
        if len(found) == k and s.dtype != object:
            near = np.flatnonzero(s >= found[-1][0])
            ids, s = ids[near], s[near]
        elif s.dtype != object and len(s) > 8 * k:
            near = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1])
            ids, s = ids[near], s[near]
        found = sorted(found + [(int(a), int(b)) for a, b in zip(s, ids) if b != query_id], key=lambda x: (-x[0], x[1]))[:k]
    return found, scored


def with_floor(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """asked (vec_id, terms, ...) with floor: the kth score among SEEDS of the rows, -infinity where fewer are candidates."""
    seeds = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).collect()  # SEEDS rows at most
    ids, m = np.array([r["vec_id"] for r in seeds], np.int64), matrix([r["terms"] for r in seeds], max((len(r["terms"]) for r in seeds), default=0))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            floors = []
            for i, t in zip(b.vec_id, b.terms):
                s = np.sort(products(m, np.asarray(t, float))[ids != i])
                floors.append(float(s[-k]) * (1 - 1e-9 * np.sign(float(s[-k]))) if len(s) >= k else -np.inf)
            yield b.assign(floor=floors)

    return asked.mapInPandas(add, "vec_id long, terms array<double>, chunk int, floor double")


def found_by_shard(vectors: DataFrame, k: int, every: int, scale: int) -> DataFrame:
    """query_id, vec_id, score of each query's k best in each shard, with scored and blocks: those scored, and those there are.

    A shard without any candidate that reaches the floor gives a row whose vec_id is null.
    """
    prepare(vectors.sparkSession)
    rows = quantized(vectors, scale)
    n, queries = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, chunks = max(1, -(-n // (BLOCK * SHARD_BLOCKS))), max(1, -(-queries // CHUNK))
    index = blocks(rows.repartitionByRange(shards, "vec_id")).withColumn("shard", F.pmod(F.spark_partition_id(), F.lit(shards)))
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("terms").alias("terms")).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))
    left = with_floor(asked, rows, k).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        shard = []
        for ids, w, data, top, low in zip(b.ids, b.width, b.data, b.top, b.low):
            i = np.frombuffer(ids, np.int64)
            shard.append((i, np.frombuffer(data).reshape(len(i), w), np.frombuffer(top), np.frombuffer(low)))
        out = []
        for q, t, floor in zip(a.vec_id, a.terms, a.floor):
            found, scored = best(q, np.asarray(t, float), shard, k, floor)
            out += [(q, v, s, a.shard.iloc[0], scored, len(shard)) for s, v in found or [(None, None)]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "shard", "scored", "blocks"], dtype=object)

    return left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInPandas(meet, "query_id long, vec_id long, score long, shard int, scored int, blocks int")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each row whose vec_id is divisible by every.

    Candidates: all rows with another vec_id, each row by itself where ids repeat; queries that repeat an id count once (the
    first by its terms). Null ids or vectors, and null or non-finite components, take no part. Vectors of
    different length: missing components are 0. Fewer than k candidates: all of them. Columns other
    than vec_id and embedding are left out. Scores beyond 64 bits fail the job.
    """
    found = found_by_shard(vectors, k, every, scale).filter("vec_id IS NOT NULL")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def share_scored(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE) -> DataFrame:
    """share: blocks scored among all that queries could have met, 1 where no bound prunes; null without queries."""
    met = found_by_shard(vectors, k, every, scale).groupBy("query_id", "shard", "scored", "blocks").count()
    return met.agg((F.sum("scored") / F.sum("blocks")).alias("share"))
