"""A corpus made ready for training: rules, near-duplicates, secrets, mixture, token ids.

Every stage takes what its predecessor kept and returns the columns of documents, but the last, which returns token ids.

Defined results: documents of null, empty or blank text go with the rules; of rows of one id one stays (near_dedup), rows of null
ids all stay; every text is taken whole; ties and repeats are settled as the operators' docstrings say; empty documents give
an empty result; extra columns are dropped by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import bpe, common, mixing, quality, secrets, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.quality_filter(docs).select(*common.DOCUMENT_COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicate(docs).select(*common.DOCUMENT_COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every document stays."""
    return secrets.redact_documents(docs).select(*common.DOCUMENT_COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated until sources have their weights."""
    return mixing.mix_sources(docs).select(*common.DOCUMENT_COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("near_dedup", drop_copies),
    ("secret_scan", hide_secrets),
    ("source_mixing", mix),
    ("bpe_encoding", encode),
]

#: The fingerprints, the lexer and the encoder cannot be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again; a stage's folder goes when the next one is written.

    The folder of the last stage stays, as the result reads it.
    """
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs, before = common.table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        here = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            common.remove(spark, before)
        before = here
    return docs
