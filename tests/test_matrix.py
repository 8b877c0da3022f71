"""Exact quantiles, running sums, the feature matrix and scores of several classes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from apothecary.operators import matrix, metrics
from apothecary.operators.prefix import running_sums
from apothecary.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    rows = [("hot", float(np.exp(rng.normal() * 80))) for _ in range(1200)] + [("hot", 0.0)] * 700 + [("hot", None)] * 9
    rows += [(None, float(rng.integers(-3, 4))) for _ in range(400)] + [("one", -2.5), ("none", None)]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("bound", [65_536, 30])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_quantiles_equal_a_sort(spark, values, by, bound):
    df = spark.createDataFrame(values, "g string, v double").repartition(4)
    shares = {"least": 0.0, "low": 0.003, "middle": 0.5, "high": 0.999, "most": 1.0}
    got = exact_quantiles(df, {n: ("v", p) for n, p in shares.items()}, by, bound).collect()
    groups = {g for g, _ in values} if by else {"all"}
    assert len(got) == len(groups)
    for row in got:
        mine = [v for g, v in values if v is not None and (not by or g == row["g"])]
        for n, p in shares.items():
            assert row[n] == pytest.approx(np.quantile(mine, p), rel=1e-9) if mine else row[n] is None


def test_quantiles_of_equal_empty_and_too_many(spark):
    same = spark.range(3000).select(F.lit(7).alias("v"), (F.col("id") % 30).alias("g"))
    assert exact_quantiles(same, {"m": ("v", 0.5)}, bound=10).collect() == [(7.0,)]
    assert exact_quantiles(same.where("false"), {"m": ("v", 0.5)}).collect() == [(None,)]
    assert exact_quantiles(same.where("false"), {"m": ("v", 0.5)}, ("g",)).collect() == []
    with pytest.raises(ValueError, match="over 20 groups"):
        exact_quantiles(same, {"m": ("v", 0.5)}, ("g",), most_groups=20)


def test_running_sums_over_ranges(spark):
    rows = [("a", x, x % 5) for x in range(500)] + [("b", x, 1) for x in range(20)] + [(None, 3, None), (None, 4, 2)]
    df = spark.createDataFrame(rows, "g string, x int, n int").repartition(5)
    got = {(r["g"], r["x"]): r["total"] for r in running_sums(df, [F.desc("x")], {"total": "n"}, ("g",)).collect()}
    assert got == {(g, x): sum(n or 0 for h, y, n in rows if h == g and y >= x) for g, x, _ in rows}


def test_classes_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0, 1, 2, None]), *[rng.choice([0.1, 0.5, 0.5, rng.random(), None]) for _ in range(4)]) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, s0 double, s1 double, s2 double, s3 double")
    got = {r["class"]: r for r in metrics.one_versus_rest(df, "y", {k: f"s{k}" for k in range(4)}).collect()}
    assert set(got) == {0, 1, 2}
    for k, row in got.items():
        p, q = ([r[k + 1] for r in rows if r[0] is not None and r[k + 1] is not None and (r[0] == k) is mine] for mine in (True, False))
        assert (row["n_positive"], row["n_negative"]) == (len(p), len(q))
        assert row["auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in p for b in q) / (len(p) * len(q)))
    (macro,) = metrics.macro_scores(metrics.one_versus_rest(df, "y", {k: f"s{k}" for k in range(4)})).collect()
    assert macro["n_classes"] == 3 and macro["macro_auc"] == pytest.approx(sum(r["auc"] for r in got.values()) / 3)
    alone = metrics.one_versus_rest(df.where("y = 1"), "y", {1: "s1"}).collect()
    assert [r["auc"] for r in alone] == [None] and metrics.macro_scores(metrics.one_versus_rest(df.where("y = 1"), "y", {1: "s1"})).first()["macro_auc"] is None


def test_parameters_come_from_the_rows_fitted_alone(spark):
    rows = [(f"d{i}", i % 4, float(i) if i % 3 else None, 5, i % 2 == 0, "train") for i in range(1, 41)] + [("new", None, 1e9, 6, None, "test"), ("zero", 1, 0.0, 5, True, "test")]
    df = spark.createDataFrame(rows, "name string, y int, mw double, same long, flag boolean, split string")
    kept = matrix.labelled(df, "y", least=1)
    assert {r["y"] for r in kept.collect()} == {1, 2, 3} and matrix.labelled(df, "y", most=3).count() == 3
    columns = matrix.feature_columns(df, ("y",))
    assert columns == ["mw", "same", "flag"]
    parameters = matrix.fit(df.where("split = 'train'"), columns, ("mw",), {"mw": "mw"}, cap=0.9)
    train = [float(r[2]) for r in rows if r[5] == "train" and r[2]]
    filled = [r[2] or float(np.median(train)) for r in rows if r[5] == "train"]
    cap = float(np.quantile(filled, 0.9))
    clean = np.minimum(filled, cap)
    found = {p["feature"]: p for p in parameters.collect()}
    assert found["mw"]["median"] == np.median(train) and found["mw"]["cap"] == pytest.approx(cap) and found["mw"]["mean"] == pytest.approx(clean.mean()) and found["mw"]["deviation"] == pytest.approx(clean.std())
    assert (found["same"]["median"], found["same"]["mean"], found["same"]["deviation"]) == (None, 5.0, 1.0)
    scaled = {r["name"]: r for r in matrix.scaled(df, parameters).collect()}
    assert scaled["new"]["mw"] == pytest.approx((cap - clean.mean()) / clean.std()) and scaled["new"]["same"] == 1.0
    assert scaled["zero"]["mw"] == pytest.approx((np.median(train) - clean.mean()) / clean.std())
    assert {r["name"]: r["mw"] for r in matrix.cleaned(df, parameters).collect()}["new"] == pytest.approx(cap)
    flags = [i % 2 == 0 for i in range(1, 41)]
    assert scaled["new"]["flag"] == pytest.approx((0 - np.mean(flags)) / np.std(flags))


def test_parameters_of_no_rows(spark):
    df = spark.createDataFrame([], "mw double, n int")
    got = {p["feature"]: (p["median"], p["cap"], p["mean"], p["deviation"]) for p in matrix.fit(df, ["mw", "n"], ("mw",), {"mw": "mw"}).collect()}
    assert got == {"mw": (0.0, 0.0, 0.0, 1.0), "n": (None, None, 0.0, 1.0)}
    assert not any(math.isnan(x) for row in got.values() for x in row if x is not None)


def test_places_of_skewed_values(spark):
    values = [0, 10**15, *range(5, 900, 3), -(10**12)]
    got = {r["x"]: r["place"] for r in metrics.numbered(spark.createDataFrame([(v,) for v in values], "x long").repartition(3), "x").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
