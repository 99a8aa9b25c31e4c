"""Command line: corpus, subset, studies, ncrna, mavedb, evaluate."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from helixframe.operators.sampling import SPLITS
from helixframe.plans import builds, studies
from helixframe.sources import archives, sinks


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="helixframe")
    sub = p.add_subparsers(dest="task", required=True)
    c = sub.add_parser("corpus")
    c.add_argument("archives", nargs="+")
    c.add_argument("--output", required=True)
    c.add_argument("--max-genomes", type=int)
    s = sub.add_parser("subset")
    s.add_argument("chunks")
    s.add_argument("--taxonomy", nargs="+", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--train-bases", type=int, default=20_000_000_000)
    s.add_argument("--validation-fraction", type=float, default=0.01)
    s.add_argument("--seed", type=int, default=17)
    d = sub.add_parser("studies")
    d.add_argument("source")
    d.add_argument("--output", required=True)
    d.add_argument("--study", action="append", choices=list(studies.STUDIES))
    for name in ("ncrna", "mavedb"):
        x = sub.add_parser(name)
        x.add_argument("archive")
        x.add_argument("--output", required=True)
    e = sub.add_parser("evaluate", help="scores variants by a scorer of your own and compares studies with reported values")
    e.add_argument("source")
    e.add_argument("--output", required=True)
    e.add_argument("--scorer", required=True, help="module:function; the function takes nothing and returns a scorer of lists of sequences")
    e.add_argument("--study", action="append")
    e.add_argument("--batch-size", type=int, default=8)
    a = p.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if a.task == "corpus":
        print(builds.build_corpus(spark, a.archives, a.output, a.max_genomes))
    elif a.task == "subset":
        out = f"{a.output.rstrip('/')}/{builds.subset_name(a.train_bases)}"
        manifest = builds.build_subset(spark, archives.chunk_shards(spark, a.chunks), archives.taxonomy(spark, a.taxonomy), out, a.train_bases, a.validation_fraction, a.seed)
        print({s: manifest.filter(manifest["split"] == s).count() for s in SPLITS})
    elif a.task == "studies":
        print(studies.standardize(spark, a.source, a.output, a.study))
    elif a.task == "ncrna":
        print(sinks.write_by_assay(studies.ncrna(spark, a.archive), a.output, sinks.NCRNA_COLUMNS))
    elif a.task == "evaluate":
        module, _, name = a.scorer.partition(":")
        builds.evaluate(spark, a.source, a.output, getattr(importlib.import_module(module), name), a.study, a.batch_size, model=a.scorer).show(truncate=False)
    else:
        counts = sinks.write_by_assay(studies.mavedb(spark, a.archive), a.output, sinks.VARIANT_COLUMNS)
        print(studies.mavedb_stats(studies.score_sets(spark, a.archive), counts, a.archive))


if __name__ == "__main__":
    main()
