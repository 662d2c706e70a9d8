"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import document_queries, kernel_queries, picture_queries, text_queries

_MODULES = (text_queries, kernel_queries, document_queries, picture_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: f for m in _MODULES for n, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {n: s for m in _MODULES for n, s in m.ORACLES.items()}
