"""Lookups by name, by unordered pair and in a small fixed library; new rows against those seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apothecary.functions.names import PREFIXES
from apothecary.functions.numbers import pair_key

#: Places and prefixes of a citation's sources: fixed values.
CITED_PLACES = {"FDA": 0, "FAERS": 1, "PubMed": 2}
CITED_PREFIXES = {"FDA": "FDA", "FAERS": "FAERS", "PubMed": PREFIXES["pubmed"]}


def property_keys(drugs: DataFrame, name: str, synonyms: str, order: str) -> DataFrame:
    """One row a key: (key, kind, ``order`` of the row that the key stands for).

    A name takes a key from all before it, so the last row of that name has
    it; a synonym has a key only where no name does, the first row winning.
    """
    own = drugs.select(F.lower(F.trim(name)).alias("key"), F.struct(F.lit(0).alias("rank"), (-F.col(order)).alias("place")).alias("claim"))
    other = drugs.select(F.explode(synonyms).alias("key"), order).select(F.lower(F.trim("key")).alias("key"), F.struct(F.lit(1).alias("rank"), F.col(order).alias("place")).alias("claim"))
    best = own.unionByName(other).where("key <> ''").groupBy("key").agg(F.min("claim").alias("claim"))
    is_name = F.col("claim.rank") == 0
    return best.select("key", F.when(is_name, "name").otherwise("synonym").alias("kind"), F.when(is_name, -F.col("claim.place")).otherwise(F.col("claim.place")).alias(order))


def pair_signals(pairs: DataFrame, signals: DataFrame, order: list[str]) -> DataFrame:
    """``pairs`` (drug_a, drug_b, ...) with the figures of the signal of each unordered pair; zeros where none is known.

    Of several signals of a pair the one with most reports counts, the first by ``order`` among equals.
    """
    key = lambda: pair_key(F.lower(F.trim("drug_a")), F.lower(F.trim("drug_b")))
    rank = F.struct("report_count", *[(-F.col(c)).alias(c) for c in order])
    best = signals.withColumn("_key", key()).groupBy("_key").agg(F.max_by(F.struct("report_count", "death_count", "max_severity"), rank).alias("_best"))
    found = pairs.withColumn("_key", key()).join(best, "_key", "left")
    reports, deaths = F.coalesce(F.col("_best.report_count"), F.lit(0)), F.coalesce(F.col("_best.death_count"), F.lit(0))
    return found.select(
        *pairs.columns, F.col("_best").isNotNull().cast("int").alias("seen"), reports.alias("report_count"), deaths.alias("death_count"), F.coalesce(F.col("_best.max_severity"), F.lit(0)).alias("max_severity"),
        F.when(reports > 0, F.bround(deaths / reports, 4)).otherwise(F.lit(0.0)).alias("death_rate"), F.bround(F.log1p(reports), 4).alias("signal_strength"),
    )


def first_flags(drugs: DataFrame, labels: DataFrame, order: str, flags: list[str]) -> DataFrame:
    """``drugs`` (drug_name, ...) with 0/1 flags of the first label of that name; 0 where there is none."""
    key = F.lower(F.trim("drug_name"))
    first = labels.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*flags), order).alias("_first"))
    return drugs.withColumn("_key", key).join(first, "_key", "left").select(*drugs.columns, *[F.coalesce(F.col(f"_first.{c}").cast("int"), F.lit(0)).alias(c) for c in flags])


def new_documents(found: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """The documents of many searches that were not seen before, each once, from the first search that found it."""
    fresh = found.join(seen.select(key), key, "left_anti")
    others = [c for c in found.columns if c != key]
    return fresh.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_first")).select(key, *[F.col(f"_first.{c}").alias(c) for c in others])


def ordered_union(*tables: DataFrame) -> DataFrame:
    """Names of several tables (name, seq), each once, with the first table and row that have it."""
    placed = [t.select("name", F.struct(F.lit(k).alias("table_no"), "seq").alias("place")) for k, t in enumerate(tables)]
    whole = placed[0]
    for more in placed[1:]:
        whole = whole.unionByName(more)
    return whole.where("name is not null").groupBy("name").agg(F.min("place").alias("place")).select("name", "place.table_no", "place.seq")


def library_matches(drugs: list[Column], entries: list[tuple[tuple[str, ...], float, str]], least: float = 0.5, most: int = 5) -> Column:
    """Ids of the entries (drugs, score, id) of a fixed library that fit all ``drugs``, best first.

    A drug fits if it holds, or is part of, a drug of the entry. The library is a constant inside the row's expression: no join.
    """
    lower = [F.lower(d) for d in drugs]
    ranked = sorted((e for e in entries if e[1] >= least), key=lambda e: -e[1])
    hits = []
    for names, _, key in ranked:
        fits = F.lit(True)
        for d in lower:
            one = F.lit(False)
            for n in names:
                one = one | F.lit(n.lower()).contains(d) | d.contains(F.lit(n.lower()))
            fits = fits & one
        hits.append(F.when(fits, F.lit(key)))
    return F.slice(F.array_compact(F.array(*hits)), 1, most)


def cited(chunks: DataFrame, query: str, severity: str, order: list[str], top_k: int = 5, least: float = 0.5) -> DataFrame:
    """One row a query: how many chunks (source, score) are cited, the keys, the first one's score and whether it is confident.

    The best ``top_k`` plus the severity of a query are cited if they score
    ``least`` or more. They are listed by source, then score, and numbered
    within their prefix. Queries without such a chunk give no row.
    """
    place = F.create_map(*[F.lit(x) for item in CITED_PLACES.items() for x in item])
    prefix = F.create_map(*[F.lit(x) for item in CITED_PREFIXES.items() for x in item])
    chunk = F.struct((-F.col("score")).alias("worse"), *order, F.coalesce(F.element_at(place, F.col("source")), F.lit(3)).alias("place"), F.coalesce(F.element_at(prefix, F.col("source")), F.lit("REF")).alias("prefix"))
    grouped = chunks.where(F.col("score") >= least).groupBy(query, severity).agg(F.sort_array(F.collect_list(chunk)).alias("_hits"))
    kept = F.slice("_hits", F.lit(1), F.lit(top_k) + F.col(severity).cast("int"))
    listed = F.array_sort(F.transform(kept, lambda x, i: F.struct(x["place"].alias("place"), i.alias("at"), x["prefix"].alias("prefix"), (-x["worse"]).alias("score"))))
    listed = grouped.select(query, listed.alias("_listed"))
    before = lambda x, i: F.size(F.filter(F.slice("_listed", F.lit(1), i + 1), lambda y: y["prefix"] == x["prefix"]))
    keys = F.transform("_listed", lambda x, i: F.concat(x["prefix"], F.lit("-"), before(x, i).cast("string")))
    top = F.get(F.col("_listed.score"), 0)
    return listed.select(query, F.size("_listed").alias("n_cited"), top.alias("top_score"), (top >= 0.75).alias("confident"), F.array_join(keys, ",").alias("keys"))
