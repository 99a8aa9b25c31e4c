"""Chosen rows of stored files as bitmaps, tested where the files are read: only chosen rows leave their scan.

A row of a file is its number there (row_index). A map is a bitmap of 32,768 rows of one file for one label. Maps are read side by side
with their files, range of file names by range, so that what a scan is sent is bounded however many rows were chosen; the scans
together read each file once. A map also tells each chosen row's place among those of its label, in the order of files and rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.sources.stored import stored

#: Maps (4 KB each) that one scan is sent, at most: 64 MB.
MAPS = 1 << 14


def row_maps(chosen: DataFrame, label: str) -> DataFrame:
    """file_name, bucket, label, bits, n, start of chosen rows (file_name, row_index, label); start: rows of the label before the map.

    Sums over maps have a row for 32,768 stored rows.
    """
    rows = chosen.select("file_name", F.bitmap_bucket_number("row_index").alias("bucket"), label, F.bitmap_bit_position("row_index").alias("bit"))
    maps = rows.groupBy("file_name", "bucket", label).agg(F.bitmap_construct_agg("bit").alias("bits")).withColumn("n", F.bitmap_count("bits"))
    before = Window.partitionBy(label).orderBy("file_name", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    return maps.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _byte(bits: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(bits, at + 1, F.lit(1))), 16, 10).cast("int")


def chosen_rows(files: DataFrame, maps: DataFrame, label: str, most: int = MAPS) -> DataFrame:
    """files (with file_name and row_index) whose rows a map of row_maps() has, with label and place, dense from 0 for each label.

    Files without chosen rows aren't read. maps should be a table: how many each file has is counted first (a row per file).
    """
    per_file = maps.groupBy("file_name").count().orderBy("file_name").collect()
    ranges: list[list[str]] = []
    size = 0
    for r in per_file:
        if not ranges or size + r["count"] > most:
            ranges.append([r["file_name"], r["file_name"]])
            size = 0
        ranges[-1][1] = r["file_name"]
        size += r["count"]
    bit = F.bitmap_bit_position("row_index")
    at, within = F.floor(bit / 8).cast("int"), (bit % 8).cast("int")
    byte = _byte(F.col("bits"), at)
    below = byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(row_index) % 8 as int))") - 1)
    hit = F.expr("shiftleft(1, cast(bitmap_bit_position(row_index) % 8 as int))").bitwiseAND(byte) > 0
    place = F.col("start") + F.bitmap_count(F.substring("bits", F.lit(1), at)) + F.bit_count(below)
    parts = []
    for first, last in ranges or [["", ""]]:
        here = lambda df: df.filter(F.col("file_name").between(first, last))  # noqa: B023, E731
        some = here(maps).withColumnRenamed("file_name", "__file")
        both = here(files).join(F.broadcast(some), (F.col("file_name") == F.col("__file")) & (F.bitmap_bucket_number("row_index") == F.col("bucket")))
        parts.append(both.filter(hit).select(*files.columns, label, place.cast("long").alias("place")))
    return reduce(DataFrame.unionByName, parts)


def stored_maps(chosen: DataFrame, label: str) -> DataFrame:
    return stored(row_maps(chosen, label), "row-maps")
