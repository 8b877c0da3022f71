"""Numbered citations: keys in order of arrival, checks of cited keys, display order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apothecary.functions.names import citation_identity, citation_prefix
from apothecary.operators.dedup import ranked

#: Places of sources and sections in a list of references: fixed values.
SOURCE_PLACES = {"dailymed": 0, "faers": 1, "pubmed": 2, "drugbank": 3}
SECTION_PLACES = {"boxed warning": 1, "contraindications": 2, "warnings and precautions": 3, "drug interactions": 4, "adverse reactions": 5}


def citation_keys(chunks: DataFrame, query: str, order: str) -> DataFrame:
    """One row a cited section: key such as FDA-1, greatest relevance, least rank, number of chunks.

    ``chunks`` has source, doc_id, section, chunk_id and relevance; duplicates
    join the first one's key, which is numbered by arrival within its prefix.
    """
    known = chunks.withColumn("identity", citation_identity(F.col("source"), F.col("doc_id"), F.col("section"), F.col("chunk_id")))
    known = known.withColumn("prefix", citation_prefix(F.col("source")))
    merged = known.groupBy(query, "prefix", "identity").agg(F.min(order).alias("first_seen"), F.max("relevance").alias("relevance"), F.count("*").alias("n_chunks"))
    numbered = ranked(merged, [query, "prefix"], [F.col("first_seen"), F.col("identity")], "number")
    return numbered.withColumn("key", F.concat("prefix", F.lit("-"), F.col("number").cast("string")))


#: Keys in a text, of known prefixes only: a fixed value.
CITED = r"\[((?:FDA|FAERS|PUB|DB|RXN|SRC)-\d+)\]"


def cited_keys(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CITED), F.lit(1)))


def compare_cited(cited: Column, known: Column) -> dict[str, Column]:
    """Keys cited but not known, and known but not cited."""
    return {"unknown": F.array_sort(F.array_except(cited, known)), "unused": F.array_sort(F.array_except(known, cited))}


def _place(key: Column, table: dict[str, int], default: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key), F.lit(default))


def display_place(source: Column, section: Column) -> tuple[Column, Column]:
    """Sort keys of a reference list: source, then section (underscores read as spaces)."""
    return _place(source, SOURCE_PLACES, 9), _place(F.translate(F.lower(section), "_", " "), SECTION_PLACES, 99)
