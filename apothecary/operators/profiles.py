"""Enzyme profiles of drugs and the figures of their pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apothecary.functions import cyp


def mentions(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row a mention: the other columns with place, enzyme, role and snippet."""
    rest = [c for c in texts.columns if c != text]
    return texts.select(*rest, F.posexplode(cyp.mentions(F.col(text))).alias("place", "found")).select(*rest, "place", "found.*")


def attributed(interactions: DataFrame, a: str = "drug_a", b: str = "drug_b", text: str = "description") -> DataFrame:
    """Mentions in descriptions of pairs, each given to the drug that stands nearer; texts under 20 letters are skipped."""
    rows = interactions.where(F.length(text) >= 20)
    found = mentions(rows.withColumn("_text", F.col(text)), "_text")
    return found.withColumn("drug", cyp.nearer(F.col(text), F.col("enzyme"), F.col(a), F.col(b))).where("drug is not null").drop(text)


def enzyme_profiles(found: DataFrame, drug: str, order: list[str]) -> DataFrame:
    """One row a drug (by lower-case name): sorted enzymes by role and the first snippet."""
    sets = [F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("enzyme")))).alias(role) for role in cyp.ROLES]
    return found.groupBy(F.lower(F.trim(drug)).alias("drug")).agg(*sets, F.min_by("snippet", F.struct(*order)).alias("snippet"))


def pair_figures(pairs: DataFrame, profiles: DataFrame, a: str = "drug_a", b: str = "drug_b") -> DataFrame:
    """``pairs`` with the twelve figures and a snippet; a drug without a profile counts as one without enzymes."""
    for name, side in ((a, "a"), (b, "b")):
        renamed = profiles.select(F.col("drug").alias(f"_{side}"), *[F.col(c).alias(f"_{side}_{c}") for c in (*cyp.ROLES, "snippet")])
        pairs = pairs.withColumn("_key", F.lower(name)).join(renamed, F.col("_key") == F.col(f"_{side}"), "left").drop("_key", f"_{side}")
    figures = cyp.pair_figures(*[{r: F.col(f"_{side}_{r}") for r in cyp.ROLES} for side in "ab"])
    out = pairs.withColumns(figures).withColumn("cyp_snippet", F.coalesce("_a_snippet", "_b_snippet", F.lit("")))
    return out.drop(*[f"_{side}_{c}" for side in "ab" for c in (*cyp.ROLES, "snippet")])
