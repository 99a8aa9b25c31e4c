"""Chunking of records as they land: the batch transforms on a stream, and windowed counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixframe.operators import corpus


def chunk_stream(records: DataFrame, length: int = corpus.CHUNK) -> DataFrame:
    """corpus.chunks of a streaming table of records; it is narrow, so it needs no state."""
    return corpus.chunks(records, length)


def windowed_counts(events: DataFrame, time_col: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, key, n of a stream, rows later than the watermark left out; state is dropped behind it."""
    w = events.withWatermark(time_col, late).groupBy(F.window(time_col, width), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), key, "n")


def append_to(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there as Parquet, once; a rerun takes only what is new."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
