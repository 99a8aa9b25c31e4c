"""Ranges of ordered values between quantiles: what lets many tasks number or sum rows in one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = 256
#: Rows that make a range worth its comparisons.
RANGE_ROWS = 1 << 16


def enough(rows: int) -> int:
    """Ranges for so many rows: fewer for small tables, RANGES at most."""
    return min(RANGES, max(2, rows // RANGE_ROWS))


def bounds(rows: DataFrame, *columns: str, ranges: int = RANGES) -> list[list]:
    """Quantiles of each column, each once and in order, ranges - 1 at most; one pass, partial aggregates only."""
    found = rows.agg(*[F.percentile_approx(c, [i / ranges for i in range(1, ranges)], 10 * ranges) for c in columns]).first()
    return [sorted(set(x or [])) for x in found]


def place(known: list, x: Column, step: int = 32) -> Column:
    """How many of the sorted bounds are x or less; null for null. Every step-th bound is tried first, then those up to the next."""
    if not known:
        return F.when(x.isNotNull(), F.lit(0))
    below = lambda some: F.size(F.filter(some, lambda b: b <= x))
    coarse, fine = (F.array(*[F.lit(b) for b in some]) for some in (known[::step], known))
    block = below(coarse)
    return F.when(x.isNotNull(), F.when(block == 0, 0).otherwise((block - 1) * step + below(F.slice(fine, (block - 1) * step + 1, F.lit(step)))))
