"""Writers of the stages' tables. Each writes Parquet or JSON in parallel and returns nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apothecary.functions.vectors import unit
from apothecary.operators.stores import upsert_last


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table under its name, replacing what is there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_chunks(chunks: DataFrame, folder: str, priority: str = "priority") -> None:
    """All chunks parted by source, and those of priority once more by themselves."""
    chunks.write.mode("overwrite").partitionBy("source").parquet(f"{folder}/all_chunks")
    chunks.where(F.col(priority)).write.mode("overwrite").parquet(f"{folder}/priority_chunks")


def with_unit_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.withColumn(f"{vector}_norm", unit(F.col(vector)))


def next_vectors(current: DataFrame, changes: DataFrame, key: str = "chunk_id", version: str = "version") -> DataFrame:
    """The vector table after an upsert: each key's latest row."""
    return upsert_last(current, changes, [key], version)


def file_label(label: Column) -> Column:
    """A label that is fit for a file's name, of at most 60 letters."""
    return F.left(F.regexp_replace(label, r"[^\w\-]", "_"), F.lit(60))


def write_raw(records: DataFrame, folder: str, label: str) -> None:
    """Records as JSON, a folder a label."""
    records.withColumn("label", file_label(F.col(label))).write.mode("overwrite").partitionBy("label").json(folder)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(name))


def write_splits(rows: DataFrame, parameters: dict[str, DataFrame], folder: str) -> None:
    """A feature matrix parted by its column ``split``, beside one table for each kind of parameter."""
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/matrix")
    write_tables(parameters, folder)
