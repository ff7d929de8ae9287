"""A training-data pipeline over the documents table: what each stage keeps is the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode, load_ranks
from tessera.llm.common import load, materialize
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.language_id import keep_identified
from tessera.llm.near_dup import drop_near_duplicates
from tessera.llm.secrets import redacted


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letters, or letters that no learned language has."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near copies, the document of the least id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark."""
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets, also those inside nested encodings, by a mark; keeps all documents."""
    clean = docs.withColumn("text", redacted(F.col("text")))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the token ids of each document's text."""
    ranks = load_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = encode(docs, ranks, public_tokenizers.PATTERN, ["doc_id", "lang", "source"])
    return out.select("_keep.*", F.size("_tokens").cast("long").alias("n_tokens"), F.col("_tokens").alias("tokens"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("tokens", tokens),
]

#: Trained models, hashes and merges are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
