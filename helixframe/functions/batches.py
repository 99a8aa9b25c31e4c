"""Arrow batches of text that Python tasks see: their size, and their bytes as NumPy arrays."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows and bytes of an Arrow batch that a Python task holds at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bounded(spark: SparkSession | None = None) -> None:
    """Bounds the Arrow batches of the (active) session, unless it sets their size itself, and lets Python workers import this package."""
    spark = spark or SparkSession.active()
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    own = spark.conf.getAll
    for key, value in BATCH.items():
        if key not in own:
            spark.conf.set(key, str(value))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text starts, and where the last one ends, in all texts' UTF-8; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)


def whole_codons(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Texts of these sizes that follow one another, each without the one or two bytes beyond its last whole codon."""
    ends, over = np.cumsum(sizes), sizes % 3
    return np.delete(data, np.concatenate([ends[over >= 1] - 1, ends[over == 2] - 2]))


def texts(data: np.ndarray, sizes: np.ndarray, valid: pa.Array) -> pa.Array:
    """Strings of these sizes out of their bytes; null where they aren't valid."""
    ends = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pc.if_else(valid, pa.StringArray.from_buffers(len(sizes), ends, pa.py_buffer(np.ascontiguousarray(data))), None)
