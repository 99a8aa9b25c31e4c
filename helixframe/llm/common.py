"""What the operators share: where cut lineage is kept, and how Python tasks find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows and bytes of an Arrow batch that a Python task holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches, unless the session sets their size itself, and lets Python workers import this package.

    The package's folder joins the workers' PYTHONPATH: on a cluster it has to be installed at the same place or, with
    --py-files, to come with the job.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    own = spark.conf.getAll
    for key, value in ARROW.items():
        if key not in own:
            spark.conf.set(key, str(value))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir.

    Where that is unset, local masters get a temporary folder of the session's; elsewhere it is an error, as other
    executors couldn't read such a folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("helixframe.shared.dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="helixframe-")
            spark.conf.set("helixframe.shared.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, under: str | None = None) -> DataFrame:
    """df as a written table: lineage ends here, and a lost executor costs no earlier work. It is a new folder, in `under` if given."""
    path = f"{under}/{name}-{uuid.uuid4().hex}" if under else shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a path of shared_dir through Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for tables that are read within the block only; it is deleted behind it."""
    path = shared_dir(spark, name)
    try:
        yield path
    finally:
        dropped(spark, path)


#: Least and most bits of a filter of ids: what is broadcast is 16 MB at most.
FILTER_BITS = (1 << 16, 1 << 27)


def with_maybe(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """rows with maybe: false only for rows whose column isn't among ids' (null counts as a value).

    A bitmap of hashed ids is broadcast. It has 32 bits an id up to FILTER_BITS[1]; beyond that it spares less and less, but
    stays right. ids should be a table, as it is counted first.
    """
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (32 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    maps = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(F.col("__bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumn("__p", place).withColumn("__part", F.bitmap_bucket_number("__p")).withColumn("__bit", F.bitmap_bit_position("__p"))
    hit = (F.expr("shiftright(__byte, cast(__bit % 8 as int))").bitwiseAND(1)) == 1
    return placed.join(F.broadcast(maps), "__part", "left").withColumn("__byte", byte).withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("__p", "__part", "__bit", "__byte", "__bits")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
