"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document draws an exponential key, divided by its quality weight; a source's documents in key
order are a weighted sample without replacement of every length. A source's budget is spent on
whole epochs first, then on the head of that order. The order of a large source is never sorted in
one task: keys are cut into bands by the exponential's distribution function, bands are summed, and
only a band's own rows are ordered together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import kept

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in code-point order, repeating (fixed values of the contract).
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE, MAX_EPOCHS = 1.5, 2.0
#: Fewest bands of keys per source, and rows of all documents a band; a band of a source is what one task orders.
BANDS, BAND_ROWS = 1024, 1 << 20
SEED = 17
#: Quality weights by label; documents without a label have the middle one.
QUALITY = {1: 1.0, 0: 0.25}
UNKNOWN = 0.5


def keyed(docs: DataFrame, weight, seed: int = SEED, bands: int = BANDS) -> DataFrame:
    """docs (doc_id, source, size) with key, an exponential draw over the weight, and band, increasing with key.

    band: of the mean of the keys' distribution functions at the weights in use, so that no weight's rows crowd into one.
    The draw is a function of seed and doc_id alone. Weights that are null or not above 0 count as
    the smallest that is used, so no document is left out.
    """
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)
    w = F.greatest(F.coalesce(weight, F.lit(UNKNOWN)), F.lit(1e-3))
    rates = sorted({*QUALITY.values(), UNKNOWN})
    share = sum((1 - F.exp(-F.col("key") * r) for r in rates), F.lit(0.0)) / len(rates)
    return docs.withColumn("key", -F.log(u) / w).withColumn("band", F.least(F.floor(share * bands), F.lit(bands - 1)).cast("int"))


def targets(sizes: DataFrame, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of each source (rows: source, source_size), targets in words.

    total_share of all words is shared by weight; no target is above max_epochs times its source,
    and what is left over goes to the others by weight. With r = cap / weight in rising order the
    first k sources are capped, k the least for which the rest's common level stays within the
    next r. Works on one row per source.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    by_r = Window.orderBy("r", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(0))
    rows = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(one) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("r", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_rows) * total_share)
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_r.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(by_r.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", F.greatest((F.col("total") - F.col("capped")) / F.col("open_weight"), F.lit(0.0)))
        .withColumn("found", F.min(F.when(F.col("level") <= F.col("r"), F.col("r"))).over(all_rows))
        .withColumn("common", F.min(F.when((F.col("r") == F.col("found")) & (F.col("level") <= F.col("r")), F.col("level"))).over(all_rows))
    )
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("common") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, cut_last: bool = True, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, source, size, weight) with source_size, target, copies (whole ones), taken.

    epochs = floor(target / source_size) whole copies of each document come first; the rest of the
    budget goes down the key order. cut_last: the document at the budget's end gives just the words
    that are left (taken isn't then a multiple of its size); else it is taken whole if that ends
    nearer to the budget.

    Null source: a source of its own, last in order. Null doc_id: takes part like any id. Repeated
    rows share a key and stand next to each other. Size 0: never taken beyond whole epochs, takes
    no words. No rows: none.
    """
    bands = max(BANDS, docs.count() // BAND_ROWS)
    rows = kept(keyed(docs, F.col("weight"), seed, bands).drop("weight"), "mix-keys")
    bands = rows.groupBy("source", "band").agg(F.sum("size").alias("band_size"))
    goals = targets(bands.groupBy("source").agg(F.sum("band_size").alias("source_size")), total_share, max_epochs)
    before = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    steps = bands.withColumn("start", F.coalesce(F.sum("band_size").over(before), F.lit(0))).alias("b").join(
        goals.alias("g"), F.expr("b.source <=> g.source")
    ).select("b.source", "b.band", "start", "source_size", "target")
    inside = Window.partitionBy("rows.source", "rows.band").orderBy("key", "doc_id", "size")
    j = rows.alias("rows").join(steps.alias("steps"), F.expr("rows.band = steps.band AND rows.source <=> steps.source"))
    prior = F.col("start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    j = j.select("doc_id", "rows.source", "size", "source_size", "target", "key", epochs.cast("long").alias("epochs"), prior.alias("prior"))
    left = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long") - F.col("prior")
    whole = F.when((F.col("size") > 0) & (left >= F.col("size")), 1).when((F.col("size") > 0) & (left > 0) & (2 * left >= F.col("size")), 0 if cut_last else 1).otherwise(0)
    j = j.withColumn("copies", F.col("epochs") + whole)
    part = F.when(F.col("copies") > F.col("epochs"), F.lit(0)).otherwise(F.greatest(F.least(left, F.col("size")), F.lit(0)))
    return j.withColumn("taken", (F.col("copies") * F.col("size") + (part if cut_last else F.lit(0))).cast("long")).drop("epochs", "prior", "key")


def quality(labels: DataFrame) -> DataFrame:
    """doc_id, weight of labelled documents: the mean of their labels' weights; unknown labels count as none."""
    w = F.create_map(*[F.lit(x) for kv in QUALITY.items() for x in kv])
    return labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.coalesce(F.try_element_at(w, F.col("quality").cast("int")), F.lit(UNKNOWN))).alias("weight"))


def sized(docs: DataFrame, labels: DataFrame | None, text_col: str = "text") -> DataFrame:
    """doc_id, source, size (words of the whole text; null: 0), weight."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return rows.withColumn("weight", F.lit(UNKNOWN)) if labels is None else rows.join(quality(labels), "doc_id", "left")


def mixed_docs(docs: DataFrame, labels: DataFrame | None, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs (all columns), each row as often as the mix takes it; only whole documents are taken.

    Rows with the same doc_id, source and size are taken equally often. Null text: size 0.
    """
    chosen = mix(sized(docs, labels), False, total_share, max_epochs, seed).filter("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("__copies"))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumn("__size", size).alias("d").join(chosen.alias("c"), F.expr("d.doc_id <=> c.doc_id AND d.source <=> c.source AND d.__size = c.size"))
    return rows.select("d.*", "__copies").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).drop("__size", "__copies", "__copy")
