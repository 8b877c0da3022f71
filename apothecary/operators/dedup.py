"""Keep-first operators. Order is always given: rows of a DataFrame have none of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apothecary.functions.numbers import pair_key
from apothecary.functions.text import content_hash


def keep_first(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``, nulls last, through one aggregation: a frequent key is combined before the shuffle."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names, strict=True)])
    rank = F.struct(*[c for i, o in enumerate(order) for c in (o.isNull().alias(f"_n{i}"), o.alias(f"_o{i}"))])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return keyed.groupBy(*names).agg(F.min_by(row, rank).alias("row")).select("row.*")


def latest_version(df: DataFrame, case: str, version: Column, tie: Column) -> DataFrame:
    """Each case's row of the highest version (text that is no number counts as 0), smallest ``tie`` first."""
    return keep_first(df, [case], [-F.coalesce(version, F.lit(0.0)), tie])


def one_of_each_pair(df: DataFrame, a: str, b: str, order: list[Column]) -> DataFrame:
    """The first row of each unordered pair."""
    return keep_first(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), [pair_key(F.col(a), F.col(b))], order)


def one_of_each_text(df: DataFrame, text: str, order: list[Column]) -> DataFrame:
    """The first row of each text, whatever its case."""
    return keep_first(df, [content_hash(F.col(text))], order)


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark prunes to k a key before the shuffle."""
    return ranked(df, keys, order, name).where(F.col(name) <= k)
