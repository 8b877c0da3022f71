"""Operators on small fixtures: traps, ties, nulls and stores."""

from pyspark.sql import functions as F

from apothecary.operators import citations, dedup, graph, metrics, pairs, retrieval, signals, stores
from apothecary.operators.tasks import tasks_for
from tests.conftest import SMALL


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_keep_first_takes_null_keys_as_one_group(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "k string, v int")
    assert sorted(dedup.keep_first(df, ["k"], [F.col("v")]).collect(), key=str) == sorted([(None, 1), ("a", 3)], key=str)


def test_latest_version_reads_bad_versions_as_zero(spark):
    df = spark.createDataFrame([("c", "x", 1), ("c", "2", 2), ("c", "10", 3)], "case_id string, v string, seq int")
    assert rows(dedup.latest_version(df, "case_id", F.col("v").try_cast("double"), F.col("seq"))) == [("c", "10", 3)]


def test_outcomes_fan_out_and_null_reports_are_left_out(spark):
    drugs = spark.createDataFrame([(1, "A"), (1, "B"), (1, "B"), (None, "A"), (None, "B")], "report int, drug string")
    outs = spark.createDataFrame([(1, "DE"), (1, "DE"), (1, "zz")], "report int, code string")
    assert rows(signals.pair_cooccurrence(drugs, outs, 1)) == [("A", "B", 1, 2, 0, 5)]
    assert rows(signals.worst_outcomes(outs)) == [(1, "death", 5)]


def test_a_report_without_outcome_counts_as_one(spark):
    drugs = spark.createDataFrame([(1, "A")], "report int, drug string")
    events = spark.createDataFrame([(1, "E")], "report int, event string")
    none = spark.createDataFrame([], "report int, max_severity int")
    assert rows(signals.drug_event_signal(drugs, events, none)) == [("A", "E", 1, 1.0, 1)]


def test_sweep_makes_no_pair_of_known_drugs(spark):
    new = spark.createDataFrame([(1, "n"), (1, "m")], "p int, d string")
    known = spark.createDataFrame([(1, "a"), (1, "b"), (1, "n"), (2, "z")], "p int, d string")
    assert rows(pairs.sweep(new, known, "p", "d")) == [(1, "a", "m"), (1, "a", "n"), (1, "b", "m"), (1, "b", "n"), (1, "m", "n")]


def test_lookup_in_either_order(spark):
    asked = spark.createDataFrame([("Warfarin", "ASPIRIN"), ("x", "y")], "a string, b string")
    known = spark.createDataFrame([("aspirin", "warfarin", 3)], "drug_a string, drug_b string, severity int")
    assert rows(pairs.lookup(asked, known, "a", "b", ["severity"]).select("a", F.coalesce("severity", F.lit(0)))) == [("Warfarin", 3), ("x", 0)]


def test_stores(spark):
    now = spark.createDataFrame([("k", 1, "old"), ("j", 5, "kept")], "k string, v int, t string")
    change = spark.createDataFrame([("k", 1, "new")], "k string, v int, t string")
    assert rows(stores.upsert_last(now, change, ["k"], "v")) == [("j", 5, "kept"), ("k", 1, "new")]
    lists = spark.createDataFrame([(1, "a", True), (2, "b", True)], "p int, d string, active boolean")
    assert rows(stores.replace_list(lists, spark.createDataFrame([(1, "c")], "p int, d string"), "p").select("p", "d", "active")) == [(1, "a", False), (1, "c", True), (2, "b", True)]
    assert rows(stores.patch(lists, spark.createDataFrame([(2, "B")], "p int, d string"), ["p"], ["d"]).select("p", "d")) == [(1, "a"), (2, "B")]
    assert stores.with_defaults(lists, {"label": F.lit("none"), "d": F.lit("?")}).select("label").distinct().collect()[0][0] == "none"


def test_fusion_of_one_sided_hits(spark):
    dense = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id int, chunk_id int, rank int")
    sparse = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id int, chunk_id int, rank int")
    got = {r["chunk_id"]: (r["rank"], r["dense_rank"], r["sparse_rank"]) for r in retrieval.fuse(dense, sparse).collect()}
    assert got == {20: (1, 2, 1), 10: (2, 1, -1), 30: (3, -1, 2)}


def test_queries_beyond_the_broadcast_limit_are_joined_by_blocks(spark, monkeypatch):
    corpus = spark.read.parquet(f"{SMALL}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    queries = corpus.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    whole = rows(retrieval.dense_top_k(queries, corpus, 3).select("query_id", "rank", "chunk_id"))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 3)
    assert rows(retrieval.dense_top_k(queries, corpus, 3).select("query_id", "rank", "chunk_id")) == whole


def test_citations(spark):
    chunks = spark.createDataFrame([("q", "DailyMed", "d1", "warnings", 1, 0.4), ("q", "faers", "f1", "", 2, 0.2), ("q", "label", "D1", "Warnings", 3, 0.9)], "q string, source string, doc_id string, section string, chunk_id int, relevance double")
    assert rows(citations.citation_keys(chunks, "q", "chunk_id").select("key", "relevance", "n_chunks")) == [("FAERS-1", 0.2, 1), ("FDA-1", 0.9, 2)]
    assert spark.range(1).select(citations.cited_keys(F.lit("see [FDA-1] and [PUB-2], [FDA-1], [ABC-1], [fda-2]"))).first()[0] == ["FDA-1", "PUB-2"]


def test_metrics(spark):
    labelled = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1), (None, 0.3)], "y int, s double")
    got = metrics.ranking_scores(labelled, "y", "s").first()
    assert (got["n_positive"], got["n_negative"], got["auc"]) == (2, 2, 0.625)
    split = metrics.stratified_split(spark.range(1000).withColumn("y", F.col("id") % 2), "y", "id").groupBy("y", "split").count()
    assert all(abs(r["count"] - {"train": 350, "val": 75, "test": 75}[r["split"]]) <= 1 for r in split.collect())


def test_softmax_sums_to_one(spark):
    edges = spark.createDataFrame([(1, 9, 0.5), (2, 9, 2.0), (3, 8, -4.0)], "src int, dst int, score double")
    sums = {r[0]: r[1] for r in graph.segment_softmax(edges, "dst", "score").groupBy("dst").agg(F.sum("weight")).collect()}
    assert abs(sums[9] - 1) < 1e-6 and abs(sums[8] - 1) < 1e-6


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_reports_of_drug_events_are_summed_up_not_listed(spark, capsys):
    """no table of the reports of each pair; nulls and repeated rows count as in the join."""
    drugs = spark.createDataFrame([(1, "A"), (1, "A"), (1, None), (2, "A"), (None, "A")], "report int, drug string")
    events = spark.createDataFrame([(1, "E"), (1, "E"), (1, "G"), (2, "E"), (3, "E"), (None, "E")], "report int, event string")
    worst = spark.createDataFrame([(1, 5)], "report int, max_severity int")
    got = signals.drug_event_signal(drugs, events, worst, 3)
    assert "distinct" not in plan_of(got, capsys)
    want = {("A", "E", 2, 21 / 5, 5), ("A", "G", 1, 5.0, 5), (None, "E", 1, 5.0, 5), (None, "G", 1, 5.0, 5)}
    assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in signals.drug_event_signal(drugs, events, worst).collect()} == want


def test_sweep_makes_each_pair_once(spark, capsys):
    """pairs come from the owner's row and are not made distinct over all owners; a mark that is missing is a known member's."""
    marked = spark.createDataFrame([(1, "a", True), (1, "a", False), (1, "b", None), (1, "c", False), (1, None, True), (None, "a", True), (None, "b", True), (2, "a", None), (2, "b", False), (3, "b", True), (3, "a", True)], "p int, d string, new boolean")
    got = pairs.sweep_marked(marked, "p", "d", "new", 3)
    assert not [line for line in plan_of(got, capsys).splitlines() if "Aggregate" in line and "drug_a" in line]
    assert rows(got) == [(1, "a", "b"), (1, "a", "c"), (3, "a", "b")]


def test_tasks_grow_with_the_rows(spark):
    assert tasks_for(spark.range(0)) == tasks_for(spark.range(1000)) == 1
    assert tasks_for(spark.range(1000), most=10) == 100
    assert tasks_for(spark.range(1000), most=1000, least=100) == min(10, int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_batches_of_documents_score_as_postings_do(spark, monkeypatch):
    """ties, copies, repeated words, empty and null texts, the same from weights sent whole and from postings; blocks of one document too."""
    said = ["a b c a", "a b c a", "b b d", "", None, "x y z a", "c", "d d d d e", "e A b"] * 4
    docs = spark.createDataFrame(list(enumerate(said)), "chunk_id long, text string")
    queries = spark.createDataFrame([("p", "a a d"), ("q", "e nothing b"), ("r", ""), ("s", None), ("t", "unseen")], "query_id string, text string")
    find = lambda: rows(retrieval.bm25_top_k(queries, docs, 5).select("query_id", "rank", "chunk_id", F.round("score", 9)))
    whole = find()
    assert {r[0] for r in whole} == {"p", "q"} and len(whole) == 10
    monkeypatch.setattr(retrieval, "BROADCAST_WEIGHTS", 0)
    assert find() == whole
