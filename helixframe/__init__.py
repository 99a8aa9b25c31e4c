"""Spark-first analytics over sequence corpora and variant-effect benchmarks."""
