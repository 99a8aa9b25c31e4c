"""Corpus build, subset build and evaluation, end to end."""

from __future__ import annotations

import platform
from datetime import UTC, datetime

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import scores
from helixframe.operators import corpus, evaluation, rowmaps, sampling
from helixframe.sources import archives, sinks
from helixframe.sources.stored import stored

RELEASE = "R232"
#: Genomes whose starts are broadcast, at most (a few tens of MB).
MOST_BROADCAST = 1 << 19
#: Columns of the genome manifest, in order.
MANIFEST = ["gtdb_accession", "domain", "phylum", "class", "order", "family", "genus", "species", "split", "available_full_chunks", "selected_chunks"]


def build_corpus(spark: SparkSession, paths: list[str], output: str, max_genomes: int | None = None, length: int = corpus.CHUNK, rows_per_file: int = 100_000) -> dict:
    """Tar archives of genomes to chunk shards and processing_stats.json under output; returns the statistics.

    Members travel as they are stored, compressed, and are unpacked once; chunks are kept on the executors' disks, with their lineage,
    while genomes are counted. A chunk's place is its genome's start (genomes in the order of accessions, one row each) and its number
    in the genome, so sequences are shuffled once, straight to their shards.
    """
    found = archives.load(spark, "member_bytes", paths, member="*" + archives.GENOME_SUFFIX)
    if max_genomes is not None:
        found = archives.first_genomes(found, max_genomes)
    cut = corpus.member_chunks(found.withColumn("__deal", F.xxhash64("archive", "member_ordinal")).repartition("__deal"), length)
    cut = cut.withColumn("ncbi_accession", scores.ncbi_accession(F.col("archive_path"))).withColumn("gtdb_accession", scores.gtdb_accession(F.col("ncbi_accession"))).persist(StorageLevel.DISK_ONLY)

    def write(folder: str) -> None:
        key = ["gtdb_accession", "archive", "member_ordinal"]
        genomes = stored(cut.groupBy(*key).agg(F.count("ordinal").alias("n")), "genomes")
        before = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)  # a row per genome
        starts = genomes.select("archive", "member_ordinal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        some = genomes.agg(F.count("*").alias("genomes"), F.sum("n").alias("chunks")).first()
        starts = F.broadcast(starts) if some["genomes"] <= MOST_BROADCAST else starts
        placed = cut.filter("ordinal IS NOT NULL").join(starts, ["archive", "member_ordinal"])
        if some["chunks"]:
            rows = corpus.named_chunks(placed, (F.col("start") + F.col("ordinal")).alias("place"))
            sinks.write_placed(rows, folder, rows_per_file, F.col("place"), some["chunks"], columns=rows.columns[:-1])
        write.stats = sinks.write_stats(corpus.cut_stats(cut, length), f"{folder}/processing_stats.json", gtdb_release=RELEASE, chunk_length=length)

    try:
        sinks.publish(spark, output, write)
    finally:
        cut.unpersist()
    return write.stats


def build_subset(spark: SparkSession, chunks: DataFrame, taxonomy: DataFrame, output: str, train_bases: int, fraction: float = 0.01, seed: int = 17, length: int = corpus.CHUNK, exact: bool = True, rows_per_file: int = 10_000) -> DataFrame:
    """Selected chunks by split, genome_manifest.parquet and subset_stats.json under output; returns the manifest.

    chunks: stored chunk rows with file_name and row_index. All checks come before any write. exact: chunks by
    NumPy's permutation; otherwise by hash, without Python.
    """
    key = "gtdb_accession"
    counts = corpus.full_chunk_counts(chunks, key, F.col("chunk_length") == length)
    genomes = stored(sampling.with_taxonomy(stored(counts, "counts"), taxonomy, key), "genomes")
    genomes = stored(sampling.assign_splits(genomes, key, "full_chunks", sampling.is_escherichia(F.col("genus")), fraction, seed), "splits")
    genomes = sampling.split_quotas(genomes, key, "full_chunks", train_bases // length, seed)
    manifest = genomes.withColumnRenamed("full_chunks", "available_full_chunks").select(*MANIFEST)

    def write(folder: str) -> None:
        sinks.write_manifest(manifest, f"{folder}/genome_manifest.parquet")
        done = spark.read.parquet(f"{folder}/genome_manifest.parquet")  # the plan is fixed from here on
        numbers = sampling.with_ordinals(chunks.filter(F.col("chunk_length") == length).select(key, "file_name", "row_index"), key, ["file_name", "row_index"]).withColumn("ordinal", F.col("ordinal").cast("long"))
        if exact:
            chosen = sampling.selected_rows(numbers, sampling.permuted_ordinals(done, key, "available_full_chunks", "selected_chunks", seed), key)
        else:
            chosen = sampling.hash_selected(numbers.join(done.select(key, "selected_chunks"), key), key, "selected_chunks", seed)
        keys = chosen.join(done.select(key, "split"), key).select("file_name", "row_index", "split")
        # Bitmaps of the chosen rows are tested where sequences are read: only chosen ones move, once, to their shards.
        rows = rowmaps.chosen_rows(chunks, rowmaps.stored_maps(keys, "split"), "split")
        sinks.write_splits(rows.drop("file_name", "row_index"), folder, sampling.SPLITS, rows_per_file, "place", sum(r[0] or 0 for r in done.select(F.sum("selected_chunks")).collect()))
        stats = {r["split"]: {k: r[k] for k in ("genomes", "chunks", "bases")} for r in sampling.split_statistics(done, length).collect()}
        held = [r[0] for r in done.filter(F.col("split") == sampling.HOLDOUT).select("genus").distinct().orderBy("genus").collect()]
        sinks.write_stats(done.agg(F.count_if(F.col("available_full_chunks") == 0).alias("genomes_without_full_chunks")), f"{folder}/subset_stats.json", selection={"seed": seed, "chunk_length": length, "validation_fraction": fraction, "holdout_genera": held}, splits={s: stats[s] for s in sampling.SPLITS})

    sinks.publish(spark, output, write)
    return manifest


def subset_name(train_bases: int) -> str:
    return f"{train_bases / 1e9:g}B_subset"


def evaluate(spark: SparkSession, source: str, output: str, load, studies: list[str] | None = None, batch: int = 8, reported: dict[str, float] = evaluation.REPORTED, model: str | None = None) -> DataFrame:
    """Scores variants under source (CSV tables) that have no prediction yet, then compares studies with reported values.

    load makes the scorer once per task; it gets wild-type and mutant sequences as they stand in mutant_nt. model: its name, for
    the run's metadata.
    """
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).csv(source)
    if studies:
        rows = rows.filter(F.col("study_id").isin(*studies))
    # Equal rows are told apart by their number among themselves, so that none of them counts as done for another.
    content = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    rows = rows.withColumn("file", F.col("_metadata.file_path")).withColumn("content", content)
    rows = rows.withColumn("row_key", F.concat_ws("-", "content", F.row_number().over(Window.partitionBy("content").orderBy("file")).cast("string"))).drop("content")
    target = f"{output}/predictions"
    p, store = sinks._path(spark, target)
    todo = evaluation.pending(rows, spark.read.parquet(target), ["row_key"]) if store.exists(p) else rows
    if todo.limit(1).count():
        evaluation.scored(todo, "mutant_nt", load, batch).select("row_key", *sinks.PREDICTION_COLUMNS).write.mode("append").parquet(target)
    done = spark.read.parquet(target)
    results = evaluation.study_correlations(done.join(rows.select("row_key").distinct(), "row_key", "left_semi"))
    out = evaluation.compared(results, reported)
    sinks.write_csv(out, f"{output}/correlations", sinks.CORRELATION_COLUMNS)
    named = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(source).select("path", F.col("_metadata.file_path").alias("file"))
    files = archives.file_digests(spark, [r["path"] for r in named.collect()]).withColumnRenamed("file", "path").join(named, "path")  # a row per file
    inputs = evaluation.input_files(rows.select("mutant_aa", "file"), files).orderBy("name")
    sinks.write_stats(inputs.agg(F.sum("rows").alias("input_rows"), F.collect_list(F.struct("*")).alias("input_files")), f"{output}/run_metadata.json", created_at=datetime.now(UTC).isoformat(), model=model, versions={"python": platform.python_version(), "spark": spark.version, "pandas": pd.__version__}, batch_size=batch, likelihood_reduction="mean", prediction_rows=done.count())
    return out
