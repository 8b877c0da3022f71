"""Names of the registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from apothecary.plans import clinical, features, matrix, records, rules, search, signals, texts

_MODULES = (signals, texts, search, rules, features, clinical, records, matrix)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.pair_cooccurrence(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
