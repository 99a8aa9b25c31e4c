"""The data-parallel parts of multi-scale vector quantization."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.dna import let

#: Codebooks are model parameters, not data; a larger one than this isn't shipped to every task.
MOST_CODEBOOK_VALUES = 1 << 26
#: Values of a codebook that stands in the plan itself.
MOST_LITERALS = 1 << 12


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nearest_code(vectors: DataFrame, codebook: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, code, distance of the closest code (code, vector); ties to the lower code.

    The codebook, whose size is checked, goes to every task, so vectors are neither shuffled nor multiplied: a small one as a
    constant array in the plan, a larger one as a matrix that Arrow batches are multiplied with.
    """
    rows = codebook.orderBy("code").limit(1 << 16).collect()
    values = sum(len(r["vector"]) for r in rows)
    if values > MOST_CODEBOOK_VALUES or len(rows) == 1 << 16:
        raise ValueError("the codebook is too large to be a parameter")
    if values > MOST_LITERALS:
        found = nearest_code_blocks(vectors, np.array([r["vector"] for r in rows], float), id_col, vector_col)
        names = F.array(*[F.lit(int(r["code"])) for r in rows])
        return found.withColumn("code", F.get(names, F.col("code")))
    codes = F.array(*[F.struct(F.lit(int(r["code"])).alias("code"), F.array(*[F.lit(float(x)) for x in r["vector"]]).alias("v")) for r in rows])
    v = F.col(vector_col).cast("array<double>")
    best = F.array_min(F.transform(codes, lambda c: F.struct(squared_distance(v, c["v"]).alias("distance"), c["code"].alias("code"))))
    return vectors.select(F.col(id_col), best.alias("b")).select(id_col, F.col("b.code").alias("code"), F.col("b.distance").alias("distance"))


def nearest_code_blocks(vectors: DataFrame, codebook: np.ndarray, id_col: str, vector_col: str) -> DataFrame:
    """As nearest_code, for large codebooks and vectors: a matrix product per Arrow batch finds the codes that may be nearest, and
    where that leaves several, their differences decide, so near and exact ties end as they do there."""
    norms = (codebook**2).sum(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b[vector_col].to_numpy()).astype(float)
            d = (x**2).sum(1, keepdims=True) + norms - 2 * x @ codebook.T
            near = d <= d.min(1, keepdims=True) + 1e-12 * codebook.shape[1] * ((x**2).sum(1, keepdims=True) + norms.max(initial=0.0))
            code = near.argmax(1)
            for i in np.flatnonzero(near.sum(1) > 1):
                some = np.flatnonzero(near[i])
                code[i] = some[((x[i] - codebook[some]) ** 2).sum(1).argmin()]
            yield pd.DataFrame({id_col: b[id_col], "code": code.astype("int32"), "distance": ((x - codebook[code]) ** 2).sum(1)})

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vector_col).mapInPandas(run, f"`{id_col}` {kind}, code int, distance double")


def code_histogram(assigned: DataFrame, codes: int, by: list[str] = []) -> DataFrame:
    """code, n of every code from 0, unused ones too (per distinct value of by)."""
    spark = assigned.sparkSession
    base = assigned.select(*by).distinct() if by else spark.range(1).drop("id")
    grid = base.withColumn("code", F.explode(F.sequence(F.lit(0), F.lit(codes - 1))))
    got = assigned.groupBy(*by, "code").agg(F.count("*").alias("n"))
    return grid.join(got, [*by, "code"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def perplexity(histogram: DataFrame, by: list[str] = []) -> DataFrame:
    """exp of the entropy of code shares; unused codes add nothing. Written as log N - sum(n log n) / N, one aggregate."""
    n = F.col("n").cast("double")
    rows = histogram.filter("n > 0").groupBy(*by).agg(F.sum(n).alias("t"), F.sum(n * F.log(n)).alias("s"))
    return rows.select(*by, F.exp(F.log("t") - F.col("s") / F.col("t")).alias("perplexity"))


def utilization(histogram: DataFrame, by: list[str] = []) -> DataFrame:
    """Share of codes in use; over several scales it is hits over codes, not the mean of shares."""
    return histogram.groupBy(*by).agg((F.count_if(F.col("n") > 0) / F.count("*")).alias("utilization"), F.count_if(F.col("n") > 0).alias("codes_used"))


def vector_sums(assigned: DataFrame, vector_col: str, code_col: str = "code") -> DataFrame:
    """code, dim, total: vectors summed by code, in partial aggregates."""
    rows = assigned.select(code_col, F.posexplode(F.col(vector_col)).alias("dim", "x"))
    return rows.groupBy(code_col, "dim").agg(F.sum(F.col("x").cast("double")).alias("total"))


def ema_update(state: DataFrame, counts: DataFrame, sums: DataFrame, decay: float, eps: float = 1e-5) -> DataFrame:
    """The codebook after one step: code, dim, ema_count, ema_sum, value, hit.

    state: code, dim, ema_count, ema_sum, hit (a row per code and dimension); counts: code, n; sums: code, dim, total.
    Counts are smoothed so that unused codes don't divide by zero.
    """
    codes = state.select("code").distinct().count()
    rows = state.join(counts, "code", "left").join(sums, ["code", "dim"], "left")
    n = F.coalesce("n", F.lit(0))
    rows = rows.select("code", "dim", (F.col("ema_count") * decay + n * (1 - decay)).alias("ema_count"), (F.col("ema_sum") * decay + F.coalesce("total", F.lit(0.0)) * (1 - decay)).alias("ema_sum"), (F.col("hit") | (n > 0)).alias("hit"))
    all_ = rows.filter("dim = 0").agg(F.sum("ema_count").alias("all"))
    smooth = (F.col("ema_count") + eps) / (F.col("all") + codes * eps) * F.col("all")
    return rows.join(F.broadcast(all_)).withColumn("value", F.col("ema_sum") / smooth).drop("all")  # one row


def world_decay(decay: float, world_size: int = 1) -> float:
    return 1 - (1 - decay) / world_size


def area_pool(values: Column, size: int) -> Column:
    """The mean over [floor(i L / S), ceil((i + 1) L / S)) for each of S bins; bins overlap where S doesn't divide L."""
    n = F.size(values)

    def one(i: Column) -> Column:
        lo = F.floor(i * n / size).cast("int")
        hi = F.ceil((i + 1) * n / size).cast("int")
        return F.aggregate(F.slice(values, lo + 1, hi - lo), F.lit(0.0), lambda s, x: s + x.cast("double")) / (hi - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one)


def linear_upsample(values: Column, size: int) -> Column:
    """Linear interpolation with half-pixel centres, clamped at both ends."""
    n = F.size(values)

    def one(i: Column) -> Column:
        at = F.greatest((i + 0.5) * n / size - 0.5, F.lit(0.0))
        lo = F.least(F.floor(at).cast("int"), n - 1)
        hi = F.least(lo + 1, n - 1)
        a, b = F.get(values, lo).cast("double"), F.get(values, hi).cast("double")
        return a + (b - a) * (at - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one)


def variance(values: Column) -> Column:
    """The population variance of an array of doubles by Welford's update, the arithmetic of SQL engines: equal to theirs to the last bit."""
    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"))

    return F.aggregate(values, none, step, lambda s: s["squares"] / s["n"])


def layer_norm(values: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(variance + eps), without learned scale."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    known = lambda x: F.struct(mean(x).alias("mean"), F.sqrt(variance(x) + eps).alias("by"))
    return let(values.cast("array<double>"), lambda x: let(known(x), lambda k: F.transform(x, lambda v: (v - k["mean"]) / k["by"])))


def learning_rate(step: Column, warmup: int, decay_end: int, top: float, floor: float) -> Column:
    """Linear warm-up, cosine to floor, then constant."""
    low = floor / top
    progress = (step - warmup) / float(max(1, decay_end - warmup))
    cosine = low + 0.5 * (1 + F.cos(F.lit(math.pi) * progress)) * (1 - low)
    ramp = (step + 1) / float(warmup + 1)
    factor = F.when(step >= decay_end, F.lit(low)).otherwise(cosine)
    return (F.when(step < warmup, ramp).otherwise(factor) if warmup > 0 else factor) * top


def code_vectors(assigned: DataFrame, codebook: DataFrame, code_col: str = "code") -> DataFrame:
    """assigned with vector, that of its code; a code that the book lacks fails."""
    rows = assigned.join(codebook.select(F.col("code").alias("__code"), "vector"), F.col(code_col) == F.col("__code"), "left")
    missing = F.raise_error(F.concat(F.lit("no such code: "), F.col(code_col).cast("string"))).cast(codebook.schema["vector"].dataType)
    return rows.withColumn("vector", F.when(F.col("__code").isNotNull(), F.col("vector")).otherwise(missing)).drop("__code")


def cumulative_errors(parts: DataFrame, keys: list[str], scale_col: str, target_col: str, part_col: str) -> DataFrame:
    """scale, mse: the mean squared error of the sum of a value's parts up to each scale (rows: keys, scale, target, part)."""
    up = Window.partitionBy(*keys).orderBy(scale_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.col(target_col).cast("double") - F.sum(F.col(part_col).cast("double")).over(up)
    return parts.select(F.col(scale_col).alias("scale"), gap.alias("gap")).groupBy("scale").agg(F.avg(F.col("gap") * F.col("gap")).alias("mse"))


def batch_means(rows: DataFrame, position: str, batch: int, values: dict[str, Column], by: list[str] = [], first: int | None = None) -> DataFrame:
    """batches, and the mean over batches of each value's mean in its batch; rows are numbered from 0 (per by). first: only so many batches."""
    rows = rows.select(*by, F.floor(F.col(position) / batch).alias("__batch"), *[v.alias(n) for n, v in values.items()])
    rows = rows if first is None else rows.filter(F.col("__batch") < first)
    one = rows.groupBy(*by, "__batch").agg(*[F.avg(n).alias(n) for n in values])
    return one.groupBy(*by).agg(F.count("*").alias("batches"), *[F.avg(n).alias(n) for n in values])


def rms(rows: DataFrame, values: Column, by: list[str] = []) -> DataFrame:
    return rows.select(*by, F.explode(values).alias("x")).groupBy(*by).agg(F.sqrt(F.avg(F.col("x").cast("double") * F.col("x"))).alias("rms"))


def constant(vectors: list[list[float]]) -> Column:
    """Vectors as a constant of the plan: Spark folds the text into one array, however many numbers it has."""
    if sum(map(len, vectors)) > MOST_CODEBOOK_VALUES:
        raise ValueError("the codebook is too large to be a parameter")
    return F.from_json(F.lit(json.dumps([[float(x) for x in v] for v in vectors])), "array<array<double>>")


def _mix(a: Column, b: Column, share: Column) -> Column:
    """a + (b - a) * share, entry by entry."""
    return F.zip_with(a, b, lambda x, y: x + (y - x) * share)


def pooled(values: Column, size: int) -> Column:
    """area_pool of an array of vectors: the mean vector of each of size bins."""
    n = F.size(values)

    def one(i: Column) -> Column:
        lo, hi = F.floor(i * n / size).cast("int"), F.ceil((i + 1) * n / size).cast("int")
        zero = F.transform(F.get(values, lo), lambda x: F.lit(0.0))
        return F.aggregate(F.slice(values, lo + 1, hi - lo), zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y), lambda s: F.transform(s, lambda x: x / (hi - lo)))

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one)


def upsampled(values: Column, size: int) -> Column:
    """linear_upsample of an array of vectors."""
    n = F.size(values)

    def one(i: Column) -> Column:
        at = F.greatest((i + 0.5) * n / size - 0.5, F.lit(0.0))
        lo = F.least(F.floor(at).cast("int"), n - 1)
        return _mix(F.get(values, lo), F.get(values, F.least(lo + 1, n - 1)), at - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one)


def nearest_in(vector: Column, book: Column) -> Column:
    """The place of the closest of a constant's vectors, the first of equals."""
    return F.array_min(F.transform(book, lambda c, i: F.struct(squared_distance(vector, c), i.alias("code"))))["code"]


def looked_up(codes: Column, book: Column, size: int) -> Column:
    """The vectors that codes stand for, at size positions."""
    return upsampled(F.transform(codes, lambda c: F.get(book, c)), size)


def _minus(a: Column, b: Column, sign: int = -1) -> Column:
    return F.zip_with(a, b, lambda u, v: F.zip_with(u, v, lambda x, y: x + sign * y))


def residual_codes(rows: DataFrame, id_col: str, value_col: str, size: int, books: list[tuple[int, list[list[float]]]]) -> DataFrame:
    """id, scale, codes, mse of each row's array of size vectors, quantized scale by scale; books: bins and codebook of each scale.

    What earlier scales leave is pooled into the scale's bins, each bin gets its nearest code, and the codes' vectors, up-sampled, are
    subtracted. mse is what is left then. A row's scales follow one another in one narrow pass: nothing is shuffled.
    """
    rows = rows.select(F.col(id_col), F.transform(value_col, lambda v: v.cast("array<double>")).alias("__left"))
    found = []
    for k, (bins, vectors) in enumerate(books):
        book = constant(vectors)
        rows = rows.withColumn(f"__codes{k}", F.transform(pooled(F.col("__left"), bins), lambda v: nearest_in(v, book)))  # noqa: B023
        rows = rows.withColumn("__left", _minus(F.col("__left"), looked_up(F.col(f"__codes{k}"), book, size)))
        total = F.aggregate("__left", F.lit(0.0), lambda s, v: s + F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))
        rows = rows.withColumn(f"__mse{k}", total / F.aggregate("__left", F.lit(0), lambda s, v: s + F.size(v)))
        found.append(F.struct(F.lit(k).alias("scale"), F.col(f"__codes{k}").alias("codes"), F.col(f"__mse{k}").alias("mse")))
    # The outer explode: a plain one's test for empty arrays would be pushed below and work every scale out again.
    return rows.select(id_col, F.explode_outer(F.array(*found)).alias("x")).select(id_col, "x.*")


def decoded(codes: DataFrame, id_col: str, size: int, books: list[tuple[int, list[list[float]]]]) -> DataFrame:
    """id, scale, values: the sum of the codes' vectors up to each scale, from residual_codes' rows; a prefix sum per row, as long as there are scales."""
    of = F.lit(None).cast("array<array<double>>")
    for k, (_, vectors) in reversed(list(enumerate(books))):
        of = F.when(F.col("scale") == k, looked_up(F.col("codes"), constant(vectors), size)).otherwise(of)
    parts = codes.select(id_col, F.struct("scale", of.alias("part")).alias("p")).groupBy(id_col).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    sums = F.aggregate("ps", F.array().cast("array<struct<scale:int,values:array<array<double>>>>"), lambda done, p: F.concat(done, F.array(F.struct(p["scale"].alias("scale"), F.when(F.size(done) > 0, _minus(F.element_at(done, -1)["values"], p["part"], 1)).otherwise(p["part"]).alias("values")))))
    return parts.select(id_col, F.inline(sums))
