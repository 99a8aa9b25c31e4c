"""Scoring variants and rank correlations of scores with measurements."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from helixframe.functions import ranges
from helixframe.functions.batches import bounded
from helixframe.sources.stored import stored

# Correlations that the paper reports, by study, and their published mean.
REPORTED = {"adkar_2012": 0.25, "chen_2020": 0.57, "firnberg_2014": 0.55, "jacquier_2013": 0.47, "kelsic_2016": 0.60, "melnikov_2014": 0.45, "rockah_shmuel_2015": 0.32, "tsuboyama_2023": 0.42, "weeks_2023": 0.50}
REPORTED_MEAN = 0.46

#: Distinct pairs of values, in all groups together, that one task may order.
FEW_PAIRS = 1 << 20


def average_ranks(rows: DataFrame, group: str, value: str, name: str, known: list | None = None, weight: str | None = None) -> DataFrame:
    """group, value, name: the rank of each distinct value (a number) in its group, ties sharing their mean rank. weight: how many rows one stands for.

    Equal values are counted first. Values are cut into ranges at quantiles (known, if they are); counts are summed by range,
    so a task orders the distinct values of one range of one group, however large the group is.
    """
    counts = rows.groupBy(group, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("__n"))
    known = ranges.bounds(rows, value)[0] if known is None else known
    counts = counts.withColumn("__range", ranges.place(known, F.col(value)))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy(group, "__range").agg(F.sum("__n").alias("__all")).withColumn("__start", F.coalesce(F.sum("__all").over(before), F.lit(0))).drop("__all")
    inside = Window.partitionBy(group, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.col("__start") + F.sum("__n").over(inside) - (F.col("__n") - 1) / 2.0
    joined = counts.alias("c").join(starts.alias("s"), F.expr(f"c.`{group}` <=> s.`{group}` AND c.__range = s.__range")).select(F.col(f"c.`{group}`"), F.col(f"c.`{value}`"), "__n", F.col("c.__range"), "__start")
    return joined.withColumn(name, rank).select(group, value, name)


def ordered_ranks(pairs: DataFrame, group: str, value: str, name: str, weight: str) -> DataFrame:
    """pairs with name: as average_ranks(), but a task orders a whole group, so pairs must be few. Several of them share one shuffle by group."""
    upto, ties = Window.partitionBy(group).orderBy(value), Window.partitionBy(group, value)
    return pairs.withColumn(name, F.sum(weight).over(upto) - (F.sum(weight).over(ties) - 1) / 2.0)


def ranked_pairs(pairs: DataFrame, few: int) -> DataFrame:
    """pairs (__g, __x, __y and how often, __m) with __rx, __ry and the mean rank __c of each group.

    Up to few pairs (they are counted) are ordered group by group after one shuffle; more are ranked range by range and joined.
    """
    n = pairs.count()
    if n <= few:
        found = ordered_ranks(ordered_ranks(pairs, "__g", "__x", "__rx", "__m"), "__g", "__y", "__ry", "__m")
        return found.withColumn("__c", (F.sum("__m").over(Window.partitionBy("__g")) + 1) / 2.0)
    sizes, found = pairs.groupBy("__g").agg(F.sum("__m").alias("n")), pairs
    for (value, rank), known in zip((("__x", "__rx"), ("__y", "__ry")), ranges.bounds(pairs, "__x", "__y", ranges=ranges.enough(n))):
        ranks = average_ranks(pairs, "__g", value, rank, known, "__m").alias("r")
        found = found.alias("p").join(ranks, F.expr(f"p.__g <=> r.__g AND p.{value} = r.{value}")).select("p.*", rank)
    return found.alias("p").join(sizes.alias("s"), F.expr("p.__g <=> s.__g")).select("p.*", ((F.col("n") + 1) / 2.0).alias("__c"))


def spearman(rows: DataFrame, group: str, x: str, y: str, few: int = FEW_PAIRS) -> DataFrame:
    """group, num_variants, spearman. Undefined (constant or single) groups give null; rows without both values don't count.

    Rows are read once and counted by (group, x, y); ranks and sizes come from that table. Sums are taken about the mean
    rank, (n + 1) / 2.
    """
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(group).alias("__g"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    pairs = stored(rows.groupBy("__g", "__x", "__y").agg(F.count("*").alias("__m")), "pairs")
    found = ranked_pairs(pairs, few)
    m, a, b = F.col("__m"), F.col("__rx") - F.col("__c"), F.col("__ry") - F.col("__c")
    sums = found.groupBy("__g").agg(F.sum("__m").alias("num_variants"), F.sum(m * a * b).alias("ab"), F.sum(m * a * a).alias("aa"), F.sum(m * b * b).alias("bb"))
    return sums.select(F.col("__g").alias(group), "num_variants", (F.col("ab") / F.nullif(F.sqrt(F.col("aa") * F.col("bb")), F.lit(0.0))).alias("spearman"))


def accuracy(rows: DataFrame, truth: str, guess: str, by: list[str] = []) -> DataFrame:
    """n, accuracy: the share of rows whose guess is the truth, over rows and not over batches; null guesses are wrong."""
    hit = F.coalesce(F.col(truth) == F.col(guess), F.lit(False))
    return rows.filter(F.col(truth).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy"))


def direction_adjusted(rows: DataFrame, score: str = "experimental_score") -> DataFrame:
    return rows.withColumn("fitness", F.col(score).cast("double") * F.col("directionality").cast("int"))


def study_correlations(predictions: DataFrame) -> DataFrame:
    """Pooled over a study's assays: likelihood against direction-adjusted fitness."""
    rows = direction_adjusted(predictions).withColumn("likelihood", F.col("evo_log_likelihood").cast("double"))
    return spearman(rows, "study_id", "likelihood", "fitness")


def compared(results: DataFrame, reported: dict[str, float] = REPORTED, mean: float = REPORTED_MEAN, key: str = "study_id") -> DataFrame:
    """results beside the reported values, and their unweighted mean once every reported study is there.

    A study that wasn't reported fails.
    """
    table = F.create_map(*[F.lit(x) for kv in reported.items() for x in kv])
    paper = F.try_element_at(table, F.col(key))
    rows = results.withColumn("reported_spearman", F.coalesce(paper, F.raise_error(F.concat(F.lit("No reported correlation: "), F.col(key))).cast("double")))
    rows = rows.select(key, "num_variants", "spearman", "reported_spearman", (F.col("spearman") - F.col("reported_spearman")).alias("difference"))
    all_ = results.agg(F.count("*").alias("k"), F.sum("num_variants").cast("long").alias("num_variants"), F.avg("spearman").alias("spearman")).filter(F.col("k") == len(reported))
    last = all_.select(F.lit("macro_average").alias(key), "num_variants", "spearman", F.lit(mean).alias("reported_spearman"), (F.col("spearman") - mean).alias("difference"))
    return rows.unionByName(last)


def macro_average(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("num_studies"), F.sum("num_variants").cast("long").alias("num_variants"), F.avg("spearman").alias("spearman"))


def pending(source: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source without a prediction yet."""
    return source.join(done.select(*keys).distinct(), keys, "left_anti")


def scored(rows: DataFrame, sequence_col: str, load: Callable[[], Callable[[list[str]], list[float]]], batch: int = 8, name: str = "evo_log_likelihood") -> DataFrame:
    """rows with a model's score of each sequence; load() makes the scorer once per task. Arrow batches are bounded in bytes, so that a
    task's memory doesn't grow with its rows."""
    bounded(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = None
        for b in batches:
            score = score or load()
            s = list(b[sequence_col])
            yield b.assign(**{name: [x for i in range(0, len(s), batch) for x in score(s[i : i + batch])]})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def base_frequency_scorer() -> Callable[[list[str]], list[float]]:
    """A stand-in for a language model: the mean log frequency of a sequence's own bases."""
    import math

    def score(sequences: list[str]) -> list[float]:
        out = []
        for s in sequences:
            n = len(s)
            out.append(sum(c * math.log(c / n) for b in set(s) if (c := s.count(b))) / n if n else 0.0)
        return out

    return score


def input_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """name, sha256, rows, stop_variants of each input (rows: file, mutant_aa; files: file, sha256)."""
    n = rows.groupBy("file").agg(F.count("*").alias("rows"), F.count_if(F.contains("mutant_aa", F.lit("*"))).alias("stop_variants"))
    return files.select("file", "sha256").join(n, "file").select(F.substring_index("file", "/", -1).alias("name"), "sha256", "rows", "stop_variants")
