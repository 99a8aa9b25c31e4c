"""Tables that cut lineage: written once under a folder that the driver and all executors share, then read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a local master may do without, with a temporary folder of the session's."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("helixframe.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("helixframe.shared.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: what is worked out from it doesn't work df out again."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
