"""Pairs of list members: combinations, sweeps of new against known, and lookups by unordered key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apothecary.functions.numbers import pair_key


def in_list(lists: DataFrame) -> DataFrame:
    """Every pair of a sorted array ``_list``, smaller first, with the other columns: made in the row, without a self join."""
    rest = [c for c in lists.columns if c != "_list"]
    firsts = lists.select(*rest, "_list", F.posexplode("_list").alias("_at", "drug_a"))
    return firsts.select(*rest, "drug_a", F.explode(F.slice("_list", F.col("_at") + 2, F.greatest(F.lit(0), F.size("_list") - F.col("_at") - 1))).alias("drug_b"))


def combinations(lists: DataFrame, owner: str, member: str) -> DataFrame:
    """Every unordered pair of each owner's distinct members, smaller first."""
    return in_list(lists.where(F.col(member).isNotNull()).groupBy(owner).agg(F.array_sort(F.collect_set(member)).alias("_list")))


def sweep(new: DataFrame, known: DataFrame, owner: str, member: str) -> DataFrame:
    """Distinct unordered pairs of each owner's new members with each other and with the known ones."""
    both = new.select(owner, member, F.lit(True).alias("_new")).union(known.select(owner, member, F.lit(False)))
    return sweep_marked(both, owner, member, "_new")


def sweep_marked(rows: DataFrame, owner: str, member: str, new: str, tasks: int | None = None) -> DataFrame:
    """``sweep`` over one table whose boolean column ``new`` tells new members (null: known ones).

    Pairs are made in the row of an owner from its distinct members: each comes
    once, so no table of the pairs of all owners is sorted or hashed. ``tasks``
    is the number of tasks that the owners are dealt to; without it Spark
    chooses one.
    """
    rows = rows.where(F.col(owner).isNotNull() & F.col(member).isNotNull()).select(owner, F.col(member).alias("_x"), F.coalesce(F.col(new), F.lit(False)).alias("_new"))
    rows = rows.repartition(*([tasks] if tasks else []), owner)
    lists = rows.groupBy(owner).agg(F.collect_set(F.when(F.col("_new"), F.col("_x"))).alias("_fresh"), F.collect_set(F.when(~F.col("_new"), F.col("_x"))).alias("_known"))
    lists = lists.where(F.size("_fresh") > 0).select(owner, "_fresh", F.array_except("_known", "_fresh").alias("_rest"))
    firsts = lists.select(owner, "_fresh", "_rest", F.posexplode("_fresh").alias("_at", "_x"))
    after = F.slice("_fresh", F.col("_at") + 2, F.greatest(F.lit(0), F.size("_fresh") - F.col("_at") - 1))
    pairs = firsts.select(owner, "_x", F.explode(F.concat(after, "_rest")).alias("_y"))
    return pairs.select(owner, F.least("_x", "_y").alias("drug_a"), F.greatest("_x", "_y").alias("drug_b"))


def lookup(pairs: DataFrame, table: DataFrame, a: str, b: str, columns: list[str], table_a: str = "drug_a", table_b: str = "drug_b") -> DataFrame:
    """``pairs`` with the table's columns by unordered pair, whatever the case; nulls where unknown.

    Of several rows of a pair the least counts, by the columns in order: one whole row, never a mix.
    """
    keyed = table.select(pair_key(F.col(table_a), F.col(table_b)).alias("_key"), *columns)
    keyed = keyed.where("_key is not null").groupBy("_key").agg(F.min(F.struct(*columns)).alias("_row")).select("_key", "_row.*")
    return pairs.withColumn("_key", pair_key(F.col(a), F.col(b))).join(keyed, "_key", "left").drop("_key")
