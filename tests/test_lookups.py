"""Lookups and records on small tables: ties, nulls, empty inputs."""

from pyspark.sql import functions as F

from apothecary.functions import records
from apothecary.operators import lookups


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_names_beat_synonyms_and_the_last_name_wins(spark):
    drugs = spark.createDataFrame([("Aspirin", ["ASA", "beta"], 1), ("Beta", ["asa"], 2), ("aspirin ", None, 3), (None, ["gamma"], 4)], "name string, words array<string>, seq long")
    assert rows(lookups.property_keys(drugs, "name", "words", "seq")) == [("asa", "synonym", 1), ("aspirin", "name", 3), ("beta", "name", 2), ("gamma", "synonym", 4)]


def test_no_drugs_no_keys(spark):
    assert rows(lookups.property_keys(spark.createDataFrame([], "name string, words array<string>, seq long"), "name", "words", "seq")) == []


def test_most_reports_count_and_unknown_pairs_are_zero(spark):
    signals = spark.createDataFrame([("B", "a", 3, 1, 2, 1), (" a", "b ", 32, 1, 4, 2), ("a", "b", 32, 9, 0, 3)], "drug_a string, drug_b string, report_count long, death_count long, max_severity long, seq long")
    pairs = spark.createDataFrame([("b", "A"), ("a", "c")], "drug_a string, drug_b string")
    assert rows(lookups.pair_signals(pairs, signals, ["seq"])) == [("a", "c", 0, 0, 0, 0, 0.0, 0.0), ("b", "A", 1, 32, 1, 4, 0.0312, 3.4965)]


def test_documents_found_twice_come_once(spark):
    found = spark.createDataFrame([(1, 5, "x"), (1, 2, "y"), (2, 1, "z")], "pmid long, seq long, query string")
    seen = spark.createDataFrame([(2,)], "pmid long")
    assert rows(lookups.new_documents(found, seen, "pmid", "seq")) == [(1, 2, "y")]


def test_citations_are_numbered_within_their_prefix(spark):
    chunks = spark.createDataFrame([(1, 1, 0.9, "PubMed", 1), (1, 1, 0.8, "FDA", 2), (1, 1, 0.95, "PubMed", 3), (1, 1, 0.4, "FDA", 4), (2, 0, 0.3, "FDA", 1), (3, 0, 0.6, None, 1)], "q long, severity long, score double, source string, seq long")
    assert rows(lookups.cited(chunks, "q", "severity", ["seq"], top_k=2)) == [(1, 3, 0.8, True, "FDA-1,PUB-1,PUB-2"), (3, 1, 0.6, False, "REF-1")]


def test_library_fits_parts_of_names(spark):
    df = spark.createDataFrame([("Warfarin sodium", "aspirin"), ("war", "ASPIRIN"), ("warfarin", "ibuprofen"), (None, "aspirin")], "a string, b string")
    hits = lookups.library_matches([F.col("a"), F.col("b")], [(("warfarin", "aspirin"), 0.9, "one"), (("warfarin", "ibuprofen"), 0.4, "low")])
    assert [r[0] for r in df.select(hits).collect()] == [["one"], ["one"], [], []]


def test_medications_and_laboratory_values(spark):
    df = spark.createDataFrame([("ibuprofen 200 mg twice daily",), ("aspirin",), (" ",), (None,)], "said string")
    got = df.select(*[c.alias(n) for n, c in records.medication_parts(F.col("said")).items()])
    assert [tuple(r) for r in got.collect()] == [("ibuprofen", "200", "mg twice daily"), ("aspirin", None, None), (" ", None, None), (None, None, None)]
    labs = spark.sql("select map('egfr', '55.5', 'inr', null, 'alt', 'high', 'other', '1') as labs")
    assert labs.select(records.lab_patch(F.col("labs"))).first()[0] == {"egfr": 55.5}
