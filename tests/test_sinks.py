"""Writers, name resolution, mentions and pair figures on small cases."""

import json
import os

import pytest
from pyspark.sql import functions as F

from apothecary.functions import cyp
from apothecary.operators import dedup, pairs, profiles, resolution, sinks, stores


def test_chunks_are_parted_by_source_and_priority(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "faers", True), (2, "faers", False), (3, "pubmed", True)], "chunk_id long, source string, priority boolean")
    sinks.write_chunks(chunks, str(tmp_path))
    assert sorted(d for d in os.listdir(tmp_path / "all_chunks") if "=" in d) == ["source=faers", "source=pubmed"]
    assert sorted(r["chunk_id"] for r in spark.read.parquet(f"{tmp_path}/priority_chunks").collect()) == [1, 3]


def test_raw_records_splits_and_json(spark, tmp_path):
    rows = spark.createDataFrame([(1, "warfarin + aspirin?", "train"), (2, "x" * 99, "test")], "id long, query string, split string")
    sinks.write_raw(rows, f"{tmp_path}/raw", "query")
    assert sorted(r["label"] for r in spark.read.json(f"{tmp_path}/raw").collect()) == sorted(["warfarin___aspirin_", "x" * 60])
    sinks.write_splits(rows, {"weights": rows.limit(1)}, f"{tmp_path}/ml")
    assert spark.read.parquet(f"{tmp_path}/ml/matrix").where("split = 'test'").count() == 1
    assert json.loads(sinks.as_json(rows.where("id = 1")).first()["json"]) == {"id": 1, "query": "warfarin + aspirin?", "split": "train"}


def test_vectors_latest_version_wins_and_none_counts_least(spark):
    now = spark.createDataFrame([(1, 5, [3.0, 4.0]), (2, None, [1.0])], "chunk_id long, version int, embedding array<double>")
    new = spark.createDataFrame([(1, None, [9.0]), (2, 1, [2.0])], "chunk_id long, version int, embedding array<double>")
    got = {r["chunk_id"]: (r["version"], r["embedding_norm"]) for r in sinks.with_unit_vectors(sinks.next_vectors(now, new)).collect()}
    assert got == {1: (5, [0.6, 0.8]), 2: (1, [1.0])}


def test_rows_without_a_version_never_beat_those_with_one(spark):
    rows = spark.createDataFrame([(1, None, "a"), (1, 2, "b")], "k long, v int, x string")
    assert dedup.keep_first(rows, ["k"], [-F.col("v")]).first()["x"] == "b"
    assert stores.upsert_last(rows.where("v = 2"), rows.where("v is null"), ["k"], "v").first()["x"] == "b"


def test_lookup_gives_one_whole_row(spark):
    table = spark.createDataFrame([("A", "b", 1, "z"), ("B", "a", 2, "c")], "drug_a string, drug_b string, severity int, note string")
    asked = spark.createDataFrame([("b", "A")], "x string, y string")
    row = pairs.lookup(asked, table, "x", "y", ["severity", "note"]).first()
    assert (row["severity"], row["note"]) == (1, "z")


@pytest.mark.parametrize(("said", "found"), [
    ("It is metabolized by CYP2C9 and CYP 3A4", [("CYP2C9", "substrate"), ("CYP3A4", "substrate")]),
    ("cyp 2d6 was seen", []),
    ("inhibitor of CYP2D6" + "." * 130 + "CYP1A2 inducer", [("CYP2D6", "inhibitor"), ("CYP1A2", "inducer")]),
    (None, None),
])
def test_mentions(spark, said, found):
    row = spark.range(1).select(cyp.mentions(F.lit(said).cast("string")).alias("m")).first()["m"]
    assert (row and [(m["enzyme"], m["role"]) for m in row]) == (found or row)


def test_roles_of_a_profile_stay_apart(spark):
    rows = spark.createDataFrame([("Drug ", "CYP2C9 inhibitor", 1), ("drug", "CYP3A4 substrate", 2)], "drug string, text string, seq long")
    (row,) = profiles.enzyme_profiles(profiles.mentions(rows), "drug", ["seq", "place"]).collect()
    assert (row["drug"], row["inhibitor"], row["substrate"], row["inducer"], row["snippet"]) == ("drug", ["CYP2C9"], ["CYP3A4"], [], "CYP2C9 inhibitor")


def test_names_resolve_by_the_first_way_that_works(spark):
    raw = spark.createDataFrame([(n,) for n in ("Warfarin 5 mg", "warfarin", "warfarinn", "clarithromicyn", "xyzzy", None)], "name string")
    terms = spark.createDataFrame([("warfarin",), ("clarithromycin",)], "term string")
    got = {r["name"]: (r["canonical"], r["match_method"]) for r in resolution.resolve(raw, terms).collect()}
    assert got == {"Warfarin 5 mg": ("warfarin", "exact"), "warfarin": ("warfarin", "exact"), "warfarinn": ("warfarin", "spelling"), "clarithromicyn": ("clarithromycin", "approx"), "xyzzy": (None, "failed")}
    assert {r["match_method"] for r in resolution.resolve(raw, terms, exact_only=True).collect()} == {"exact", "failed"}
