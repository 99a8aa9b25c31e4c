"""Writers: shards of fixed size, splits, manifests, statistics, CSV tables, and publishing a folder in one step."""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.sources.shards import write_placed

# The columns of the variant and prediction tables.
VARIANT_COLUMNS = ["panel", "study_id", "assay_id", "variant_id", "organism", "target", "wt_nt", "mutant_nt", "nt_edit", "wt_aa", "mutant_aa", "aa_change", "experimental_score", "directionality"]
NCRNA_COLUMNS = ["panel", "study_id", "assay_id", "wt_nt", "mutant_nt", "nt_edit", "experimental_score", "directionality"]
PREDICTION_COLUMNS = ["study_id", "assay_id", "experimental_score", "directionality", "evo_log_likelihood"]
CORRELATION_COLUMNS = ["study_id", "num_variants", "spearman", "reported_spearman", "difference"]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_shards(df: DataFrame, path: str, rows_per_file: int = 100_000, order: list[str] | None = None) -> int:
    """Zstandard Parquet files shard_name(0), ... of exactly rows_per_file rows, the last one of what is left; returns how many.

    Rows are in order if one is given, else as they come. Sorted rows are kept on the executors' disks, with their lineage, while each
    partition's rows are counted (a row per partition); their places then give each row its shard. Rows that are equal in order stand by
    their hash, so that a lost partition comes back as it was. No rows: an empty folder.
    """
    rows = df
    if order:
        rows = df.repartitionByRange(*order).sortWithinPartitions(*order, F.xxhash64(*df.columns))
    rows = rows.withColumn("__at", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    try:
        part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
        start = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("__part", "start")
        total = counts.agg(F.sum("n")).first()[0] or 0
        placed = rows.withColumn("__part", part).join(F.broadcast(start), "__part").withColumn("__place", F.col("start") + within)
        if total:
            write_placed(placed.select(*df.columns, "__place").withColumnRenamed("__place", "__to"), path, rows_per_file, F.col("__to"), total, columns=df.columns)
        else:
            p, store = _path(df.sparkSession, path)
            store.mkdirs(p)
    finally:
        rows.unpersist()
    return -(-total // rows_per_file)


def write_splits(df: DataFrame, path: str, splits: tuple[str, ...], rows_per_file: int = 10_000, place: str | None = None, total: int | None = None) -> None:
    """A folder for each split, empty ones too, of shards of exactly rows_per_file rows, the last one of what is left; split itself isn't stored.

    place: the column with rows' dense places in their split, if df has it (total: how many rows, about); else rows are numbered in
    the order of their hash, in bands.
    """
    df = df.filter(F.col("split").isin(*splits))
    columns = [c for c in df.columns if c not in ("split", place)]
    if place is None:
        df = df.withColumn("__hash", F.xxhash64(*columns)).persist(StorageLevel.DISK_ONLY)
        band = F.shiftright("__hash", 48)
        before = Window.partitionBy("split").orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
        starts = df.groupBy("split", band.alias("__band")).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")  # 65,536 rows a split
        inside = Window.partitionBy("split", "__band").orderBy("__hash", *columns)
        place = "__to"
        numbered = df.withColumn("__band", band).join(F.broadcast(starts), ["split", "__band"]).withColumn(place, F.col("start") + F.row_number().over(inside) - 1)
    else:
        numbered = df
    total = df.count() if total is None else total
    write_placed(numbered.select(*columns, "split", place), path, rows_per_file, F.col(place), total, F.col("split"), splits, columns)
    df.unpersist()


def write_manifest(df: DataFrame, path: str, key: str = "gtdb_accession") -> None:
    """One sorted file: a row per genome, which is metadata of bounded size."""
    df.repartitionByRange(1, key).sortWithinPartitions(key).write.option("compression", "zstd").parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file by Spark's own file systems; written beside its place, then renamed."""
    p, store = _path(spark, path)
    tmp, _ = _path(spark, path + ".tmp")
    out = store.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(p, False)
    store.rename(tmp, p)


def write_stats(df: DataFrame, path: str, **more) -> dict:
    """The one row of df, after the entries in more, as indented JSON."""
    stats = {**more, **json.loads(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])}
    write_text(df.sparkSession, path, json.dumps(stats, indent=2) + "\n")
    return stats


def write_csv(df: DataFrame, path: str, columns: list[str]) -> int:
    """A CSV table with its columns in order and empty cells for nulls; returns its rows, counted as they are written."""
    rows = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.option("header", True).option("emptyValue", "").csv(path, mode="overwrite")
    return seen.get["n"]


def write_by_assay(df: DataFrame, path: str, columns: list[str]) -> dict[str, int]:
    """A CSV table for each assay under path (assay=...), and the rows of each, counted in what was written."""
    rows = df.withColumn("assay", F.translate("assay_id", ":", "-")).select("assay", *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    rows.write.partitionBy("assay").option("header", True).option("emptyValue", "").csv(path, mode="overwrite")
    done = df.sparkSession.read.schema(", ".join(f"`{c}` string" for c in [*columns, "assay"])).option("header", True).csv(path)
    return {r[0]: r[1] for r in done.groupBy("assay_id").count().collect()}


def write_state(df: DataFrame, path: str, step: int) -> None:
    """A codebook's state after a step, as a table of its own that appears in one piece."""
    publish(df.sparkSession, f"{path}/step-{step:09d}", lambda at: df.write.mode("overwrite").parquet(at))


def last_step(spark: SparkSession, path: str) -> int | None:
    """The last step whose state stands under path."""
    p, store = _path(spark, path)
    names = [f.getPath().getName() for f in store.listStatus(p)] if store.exists(p) else []
    return max((int(n[5:]) for n in names if n.startswith("step-")), default=None)


def read_step(spark: SparkSession, path: str, step: int) -> DataFrame:
    return spark.read.parquet(f"{path}/step-{step:09d}")


def read_state(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The last step written and its state."""
    step = last_step(spark, path)
    if step is None:
        raise FileNotFoundError(f"no state under {path}")
    return step, read_step(spark, path, step)


def drop_incomplete(spark: SparkSession, path: str) -> None:
    """Deletes what a killed write_state left under path."""
    p, store = _path(spark, path)
    for f in store.listStatus(p) if store.exists(p) else []:
        if f.getPath().getName().endswith(".incomplete"):
            store.delete(f.getPath(), True)


def publish(spark: SparkSession, path: str, write) -> None:
    """write(temporary folder), then a rename to path. Neither may exist; a failed write leaves nothing behind."""
    parent, _, name = path.rstrip("/").rpartition("/")
    tmp = f"{parent}/.{name}.incomplete"
    (p, store), (t, _) = _path(spark, path), _path(spark, tmp)
    for x in (p, t):
        if store.exists(x):
            raise FileExistsError(str(x))
    try:
        store.mkdirs(t)
        write(tmp)
    except BaseException:
        store.delete(t, True)
        raise
    if not store.rename(t, p):
        raise OSError(f"{tmp} couldn't be renamed")


def append_metrics(spark: SparkSession, path: str, step: int, **values: float) -> None:
    rows = [(step, k, float(v)) for k, v in values.items()]
    spark.createDataFrame(rows, "step long, name string, value double").coalesce(1).write.mode("append").parquet(path)
