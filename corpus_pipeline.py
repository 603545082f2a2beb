"""The corpus pipeline: toxic documents go, boilerplate lines go, one document of each near-duplicate class stays, documents with benchmark items go, the rest is encoded.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its
predecessor kept and returns the columns of `documents`; the last one returns the
token ids of each document and what they decode to, as digests.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.bpe import encode_and_decode, listed
from marketloom.llm.common import stored, table
from marketloom.llm.decontaminate import drop_leaks
from marketloom.llm.line_dedup import drop_boilerplate
from marketloom.llm.near_dedup import keep_one
from marketloom.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text."""
    return drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"), verbatim=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and digests of the ids and of the bytes they decode to."""
    out = encode_and_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed(F.col("ids")).cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line-dedup", without_boilerplate),
    ("near-dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("byte-bpe", encoded),
]

#: A learned score, components of a graph and a tokenizer are not SQL; the tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written as Parquet and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
