"""Parquet tables, with declared schemas where a file may be missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_if_exists(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet table, or an empty one of the schema if there is none at the path."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def resolve_columns(df: DataFrame, wanted: dict[str, list[str] | Callable[[str], bool]], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns under canonical names, each found by the first of its candidates or by a predicate, whatever their case.

    Columns not found are left out; a required one missing is an error.
    """
    by_name = {c.strip().lower(): c for c in df.columns}
    chosen = []
    for name, how in wanted.items():
        found = next((by_name[c] for c in how if c in by_name), None) if isinstance(how, list) else next((c for low, c in by_name.items() if how(low)), None)
        if found is None and name in required:
            raise ValueError(f"no column for {name} among {df.columns}")
        if found is not None:
            chosen.append(df[f"`{found}`"].alias(name))
    return df.select(*chosen)
