"""Stored tables as sets: upserts, list replacement and point updates give the table's next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apothecary.operators.dedup import keep_first


def upsert_last(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Each key's row of the highest version among both; of equal versions the change wins."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, keys, [-F.col(version), -F.col("_new")]).drop("_new")


def upsert_greatest(current: DataFrame, changes: DataFrame, key: str, greatest: str, last: str, version: str) -> DataFrame:
    """Per key the greatest of one column and the last of another."""
    both = current.unionByName(changes)
    return both.groupBy(key).agg(F.max(greatest).alias(greatest), F.max_by(last, version).alias(last))


def replace_list(current: DataFrame, new: DataFrame, owner: str, active: str = "active") -> DataFrame:
    """Rows of owners with a new list become inactive; the new rows are added as active."""
    replaced = new.select(owner).distinct().withColumn("_replaced", F.lit(True))
    kept = current.join(replaced, owner, "left").withColumn(active, F.col(active) & F.col("_replaced").isNull()).drop("_replaced")
    return kept.unionByName(new.withColumn(active, F.lit(True)))


def patch(df: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns replaced by the updates' values where those are not null."""
    renamed = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = df.join(renamed, keys, "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in defaults.items()})


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name and row_count of each table."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionAll(df)
    return out
