"""Resolving raw names against a vocabulary: exact, by spelling, approximately, or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apothecary.functions.names import without_dose

#: Least score of an approximate match: a fixed value.
LEAST_SCORE = 80
#: Letters by which a suggested spelling may differ.
MOST_EDITS = 1


def trigrams(name: Column) -> Column:
    """Distinct runs of three letters of a name between two marks."""
    marked = F.concat(F.lit("$"), name, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - 2)), lambda k: F.substring(marked, k, F.lit(3))))


def resolve(raw: DataFrame, vocabulary: DataFrame, name: str = "name", exact_only: bool = False) -> DataFrame:
    """(name, normalised, canonical, score, match_method) for every distinct name.

    ``vocabulary`` has one lower-case ``term`` a row. Names are looked up once
    a normal form and the result goes to all their spellings. Candidates share
    a trigram, so nothing meets by a cross join; the score is 100 less the
    share of letters to change, rounded down. Ties go to the first term by name.
    """
    names = raw.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct().withColumn("normalised", without_dose(F.col("name")))
    keys = names.select("normalised").distinct()
    terms = vocabulary.select("term").distinct()
    exact = keys.join(terms, F.col("normalised") == F.col("term"), "left_semi").select("normalised", F.col("normalised").alias("canonical"), F.lit(100).cast("long").alias("score"), F.lit("exact").alias("match_method"))
    found = exact
    if not exact_only:
        open_keys = keys.join(exact, "normalised", "left_anti").withColumn("gram", F.explode(trigrams(F.col("normalised"))))
        near = open_keys.join(terms.withColumn("gram", F.explode(trigrams(F.col("term")))), "gram").select("normalised", "term").distinct()
        edits = F.levenshtein("normalised", "term")
        score = F.floor(100 * (1 - edits / F.greatest(F.length("normalised"), F.length("term"))))
        best = near.groupBy("normalised").agg(F.min(F.struct(edits.alias("edits"), F.col("term").alias("term"))).alias("spelt"), F.min(F.struct((-score).alias("score"), F.col("term").alias("term"))).alias("approx"))
        spelt = F.col("spelt.edits") <= MOST_EDITS
        canonical = F.when(spelt, F.col("spelt.term")).when(-F.col("approx.score") >= LEAST_SCORE, F.col("approx.term"))
        method = F.when(spelt, "spelling").otherwise("approx")
        found = exact.union(best.select("normalised", canonical.alias("canonical"), (-F.col("approx.score")).alias("score"), method.alias("match_method")).where("canonical is not null"))
    out = names.join(found, "normalised", "left")
    return out.select("name", "normalised", "canonical", "score", F.coalesce("match_method", F.lit("failed")).alias("match_method"))
