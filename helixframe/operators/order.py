"""Order statistics of groups of any size: no task orders more than a band of one group's rows.

Rows are counted by bands of what orders them, bands are summed, and only the band where the sought place lies is ordered. Sums over
bands have a row per band, those over groups a row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import ranges

#: Rows of a group that a band of hashes holds, about; and hexadecimal digits that tell bands apart, at most.
BAND_ROWS, MOST_DIGITS = 1 << 16, 7
#: Groups whose parameters are broadcast, at most.
BROADCAST_GROUPS = 1 << 17


def few_groups(params: DataFrame, most: int = BROADCAST_GROUPS) -> bool:
    """Whether a table with a row per group may be broadcast; it is counted up to the limit."""
    return params.limit(most + 1).count() <= most


def with_group(rows: DataFrame, params: DataFrame, group: str, few: bool) -> DataFrame:
    """rows with the columns of their group's one row in params, which is broadcast if there are few groups; null is a group.

    Beyond that a skewed group is left to adaptive execution.
    """
    other = params.withColumnRenamed(group, "__of")
    return rows.join(F.broadcast(other) if few else other, F.col(group).eqNullSafe(F.col("__of")), "left").drop("__of")


def hash_band(score: Column, digits: int) -> Column:
    """The band of a hexadecimal digest: its first digits. Digests are uniform, so bands are even, and rise with them."""
    return F.conv(F.substring(score, 1, digits), 16, 10).cast("long") if digits else F.lit(0).cast("long")


def digits_for(rows: int, band_rows: int = BAND_ROWS) -> int:
    """So many that a band of all rows holds band_rows or fewer."""
    digits = 0
    while digits < MOST_DIGITS and rows > band_rows << 4 * digits:
        digits += 1
    return digits


def nth_scores(rows: DataFrame, group: str, score: str, key: str, wanted: DataFrame, size: int, few: bool, band_rows: int = BAND_ROWS) -> DataFrame:
    """group, score_at, key_at: the wanted (group, n)-th row of each group in the order of (score, key), score a hexadecimal digest.

    Groups of which n is 0 or less, or more than they have rows, aren't in the result. size: how many rows there are, about; few: few_groups() of wanted.
    """
    rows = rows.withColumn("__band", hash_band(F.col(score), digits_for(size, band_rows)))
    up = Window.partitionBy(group).orderBy("__band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = rows.groupBy(group, "__band").agg(F.count("*").alias("__m")).withColumn("__upto", F.sum("__m").over(up))
    cut = with_group(counts, wanted.select(group, F.col("n").alias("__n")), group, few)
    cut = cut.filter("__n > __upto - __m AND __n <= __upto").select(group, "__band", (F.col("__n") - F.col("__upto") + F.col("__m")).alias("__left"))
    edge = with_group(rows.select(group, score, key, "__band"), cut.withColumnRenamed("__band", "__cut"), group, few).filter("__band = __cut")
    place = F.row_number().over(Window.partitionBy(group, "__band").orderBy(score, key))
    return edge.withColumn("__place", place).filter("__place = __left").select(group, F.col(score).alias("score_at"), F.col(key).alias("key_at"))


def up_to(score: str, key: str) -> Column:
    """Whether a row stands at or before its group's nth_scores() row; false without one."""
    before = (F.col(score) < F.col("score_at")) | ((F.col(score) == F.col("score_at")) & (F.col(key) <= F.col("key_at")))
    return F.coalesce(before, F.lit(False))


def levels(rows: DataFrame, group: str, capacity: str, targets: DataFrame, few: bool) -> DataFrame:
    """group, target, all_, level, left: of targets (group, target), by whole levels up to each member's capacity.

    level is the largest L with sum(min(capacity, L)) <= target; left is what remains of the target then. Members are counted by
    capacity, capacities are cut at quantiles, and only the range where the level lies is ordered by capacity.
    """
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    hist = rows.groupBy(group, F.col(capacity).cast("long").alias("c")).agg(F.count("*").alias("n"))
    known = ranges.bounds(rows.select(F.col(capacity).cast("long").alias("c")), "c")[0]
    hist = hist.withColumn("__range", ranges.place(known, F.col("c")))
    by_range = hist.groupBy(group, "__range").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("c")).alias("s"), F.max("c").alias("c"))
    up = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_range = by_range.withColumn("un", F.sum("n").over(up)).withColumn("us", F.sum("s").over(up))
    totals = by_range.groupBy(group).agg(F.max("un").alias("members"), F.max("us").alias("all_")).join(targets, group)
    by_range = with_group(by_range, totals.select(group, "target", "members"), group, few)
    cost = lambda s, n: F.col(s) + (F.col("members") - F.col(n)) * F.col("c")
    base = F.struct(F.col("c"), cost("us", "un").alias("cost"), F.col("un").alias("below"), F.col("us").alias("sum"), F.col("__range").alias("range"))
    whole = by_range.groupBy(group).agg(F.max(F.when(cost("us", "un") <= F.col("target"), base)).alias("b"), F.min(F.when(cost("us", "un") > F.col("target"), F.col("__range"))).alias("in_range"))
    # The range that a level can't reach the end of: its capacities alone are summed one by one.
    inside = with_group(hist, whole.select(group, "in_range", long(F.col("b.sum")).alias("s0"), long(F.col("b.below")).alias("n0")), group, few).filter("__range = in_range")
    one = Window.partitionBy(group, "__range").orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("us", F.col("s0") + F.sum(F.col("n") * F.col("c")).over(one)).withColumn("un", F.col("n0") + F.sum("n").over(one))
    inside = with_group(inside, totals.select(group, "target", "members"), group, few)
    last = inside.filter(cost("us", "un") <= F.col("target")).groupBy(group).agg(F.max(F.struct("c", cost("us", "un").alias("cost"), F.col("un").alias("below"))).alias("i"))
    found = with_group(with_group(totals, whole.select(group, "b"), group, few), last, group, few)
    at = lambda f: long(F.coalesce(F.col(f"i.{f}"), F.col(f"b.{f}")))
    found = found.select(group, "target", "all_", (F.col("members") - at("below")).alias("wider"), at("c").alias("c"), (F.col("target") - at("cost")).alias("rest"))
    extra = F.when(F.col("wider") > 0, F.floor(F.col("rest") / F.col("wider"))).otherwise(F.lit(0)).cast("long")
    left = F.when(F.col("wider") > 0, F.col("rest") - extra * F.col("wider")).otherwise(F.lit(0)).cast("long")
    return found.select(group, "target", "all_", (F.col("c") + extra).alias("level"), left.alias("left"))
