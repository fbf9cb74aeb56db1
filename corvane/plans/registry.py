"""Every query of the library proper and its SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogs, contents, evaluation, graphs, jobs, retrieval, rules, scores, shop, states, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _group in (retrieval, texts, graphs, catalogs, evaluation, states, rules, jobs, shop, scores, contents):
    QUERIES |= _group.QUERIES
    ORACLE_SQL |= _group.ORACLE_SQL
