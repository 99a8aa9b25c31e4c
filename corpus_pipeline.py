"""A corpus pipeline of five stages over documents: from raw documents to token ids of a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as
Parquet and reads them again as the next stage's docs. All stages but the last keep the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import bpe, minhash, mixing, secrets, toxicity
from helixframe.llm.common import dropped, kept, shared_dir, table

#: The stages on word shingles take five words and similarity 0.8.
SHINGLE, PERCENT = 5, 80
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """docs with the columns that a stage doesn't use under names that can't clash with the stage's own."""
    return docs.toDF(*(c if c in used else f"__kept{i}" for i, c in enumerate(docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model fitted on this folder's labels doesn't grade as toxic. Null and empty texts stay, repeated rows go or stay together."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = aside(docs, "doc_id", "text")
    return toxicity.score(rows, model).filter("NOT toxic").select(*rows.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id. Null ids stay; of repeated rows one stays, of a doc_id's different texts each."""
    return minhash.one_of_each(aside(docs, "doc_id", "text"), SHINGLE, PERCENT).toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text. A null text becomes an empty one."""
    rows = aside(docs, "doc_id", "text", "n_chars")
    found = secrets.secret_spans(rows, keep=tuple(c for c in rows.columns if c not in ("doc_id", "text", "n_chars")))
    return secrets.redacted(found).withColumn("n_chars", F.char_length("text").cast("long")).select(*rows.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole, at most twice. Null ids and sources take part; rows without words go with their source's whole epochs."""
    return mixing.mixed_docs(aside(docs, "doc_id", "text", "source"), table(spark, sf_dir, "labels")).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of each row; null and empty texts have no tokens."""
    return bpe.encode(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the stages' models, signatures and tokenizer; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is deleted once the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = shared_dir(spark, f"pipeline-{name}")
        docs = kept(stage(spark, docs, sf_dir), name, at)
        if before:
            dropped(spark, before)
        before = at
    return docs
