import numpy as np
from pyspark.sql import functions as F

from apothecary.llm import ann
from tests.conftest import SMALL


def exact(ids, x, query_ids, k):
    out = {}
    for q in query_ids:
        rows = [n for n in range(len(ids)) if ids[n] != q]
        s = ann._exact(x[rows], x[list(ids).index(q)])
        out[q] = [(int(ids[rows[n]]), float(s[n])) for n in np.lexsort((np.array(ids)[rows], -s))[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_and_exact_scores_on_random_vectors(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=float)
    got = found(ann.nearest_neighbours(df, df.where("vec_id % 10 = 0"), leaf_rows=64))
    want = exact(ids, x, [i for i in ids if i % 10 == 0], 5)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    scores = {q: dict(v) for q, v in exact(ids, x, list(got), len(ids)).items()}
    assert all(scores[q][v] == s for q, pairs in got.items() for v, s in pairs)


def test_ties_copies_and_rows_that_take_no_part(spark):
    data = [(i, [1.0, 0.0]) for i in range(20)] + [(30, [0.0, 1.0]), (31, None), (32, [0.0, 0.0]), (33, [None, 1.0]), (34, [float("nan"), 1.0]), (35, [1.0]), (None, [1.0, 0.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = found(ann.nearest_neighbours(df, df.where("vec_id in (3, 30, 31, 32)"), leaf_rows=4))
    assert [v for v, _ in got[3]] == [0, 1, 2, 4, 5] and {s for _, s in got[3]} == {1.0}
    assert [v for v, _ in got[30]] == [0, 1, 2, 3, 4]
    assert set(got) == {3, 30}


def test_fewer_candidates_than_asked_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert found(ann.nearest_neighbours(df, df)) == {1: [(2, 0.8)], 2: [(1, 0.8)]} or len(found(ann.nearest_neighbours(df, df))) == 2
    assert ann.nearest_neighbours(df.limit(0), df.limit(0)).collect() == []
