"""A corpus pipeline over documents: quality rules, near-duplicates, personal data,
mix of sources, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.llm import bpe, minhash, mixing, pii, quality
from isohyet.llm.common import table
from isohyet.llm.queries import ALPHA, DELTA, vocabulary

#: The rules cannot be said in SQL as a whole; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled rule reject go."""
    return quality.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), alpha=ALPHA, delta=DELTA)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links of 0.8 or more on five-word shingles, the one
    with the smallest doc_id stays."""
    return minhash.drop_near_duplicates(docs, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in text is replaced by its kind; n_chars counts the new text."""
    return pii.redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: of the files written, each holds a
    range of it."""
    return mixing.in_order(mixing.mix(docs)).select(docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, the digest of the text decoded from the ids, and
    mix_rank, by which the rows are ordered: files read again come in any order, so
    the mix is worked out again, which doc_id and source alone decide."""
    mixed = mixing.in_order(mixing.mix(docs.select("doc_id", "source", "text")))
    return bpe.encode(mixed, vocabulary(), ("mix_rank",)).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("text", 256).alias("decoded_sha256"), "mix_rank")


STAGES = [("quality rules", quality_stage), ("near-duplicates", near_duplicate_stage), ("personal data", pii_stage), ("mixing", mixing_stage), ("tokens", tokens_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = table(docs, f"stage-{i}")
    return docs
