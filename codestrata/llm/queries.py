"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, langid, mixing, quality, secrets, simhash, token_counts, toxicity, warc

_MODULES = (warc, langid, ann, bpe, mixing, token_counts, simhash, secrets, toxicity, quality)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
