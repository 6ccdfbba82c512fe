"""From raw documents to ids of tokens: five stages, each written and read again before the next.

1. `quality`: documents that the rules or the line labels reject go.
2. `near_dedup`: one document of each group whose five-word shingles are similar at 0.8 stays, the one with the smallest id.
3. `pii`: personal data is replaced by its kind in brackets.
4. `mix`: documents come as often as the target weights of the labelled domains ask for; every document stays at least once.
5. `encode`: ids of byte-level BPE and the bytes they decode to, with digests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, minhash, mixing, pii, quality, queries
from tessera.llm.common import shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that quality rules and line labels keep."""
    field = quality.fitted(docs, table(spark, sf_dir, "labels"))
    kept = quality.judge(docs, field, keep=tuple(docs.columns)).where("kept")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash links by deletion variants, min-wise ones where sign bits don't reach, all verified."""
    return minhash.first_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without personal data; `n_chars` counts the new text."""
    found = pii.redact(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the domains' target weights ask for, each once at least."""
    return mixing.mixed(docs, mixing.fitted(docs, queries.domains_of(table(spark, sf_dir, "labels"))), queries.TARGET_WEIGHTS, least=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with the digests of ids and decoded bytes."""
    return bpe.round_trip(docs, queries.VOCABULARY, public_tokenizers.PATTERN).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [("quality", keep_good), ("near_dedup", keep_first), ("pii", redact), ("mix", mix), ("encode", encode)]

#: SQL can't express the fitted models nor the tokenizer; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for `documents`; what each earlier stage keeps is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
