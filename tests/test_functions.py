"""Column functions against small cases and step-by-step models."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from apothecary.functions import names, numbers, rules, text, vectors
from apothecary.plans import features
from tests.conftest import SMALL


def one(spark, column, **values):
    row = spark.range(1).select(*[(F.lit(v)).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("source", "family"), [("Daily-Med", "dailymed"), ("fda_label", "dailymed"), ("PMC", "pubmed"), (None, "unknown"), ("Blog", "blog"), (" My-Src ", "my-src"), ("fda", "fda"), ("pmid", "pmid")]
)
def test_source_family(spark, source, family):
    assert one(spark, names.source_family(F.lit(source).cast("string"))) == family


@pytest.mark.parametrize(
    ("source", "doc", "existing", "url"),
    [
        ("pubmed", "PMID: 12345678", "", "https://pubmed.ncbi.nlm.nih.gov/12345678/"),
        ("drugbank", "DB00682", None, "https://go.drugbank.com/drugs/DB00682"),
        ("drugbank", "warfarin", "", ""),
        ("pubmed", "PMC1234567", "", ""),
        ("label", "abc", "", "https://dailymed.nlm.nih.gov/dailymed/drugInfo.cfm?setid=abc"),
        ("pubmed", "1", "https://kept", "https://kept"),
    ],
)
def test_document_url(spark, source, doc, existing, url):
    assert one(spark, names.document_url(F.lit(source), F.lit(doc), F.lit(existing).cast("string"))) == url


def test_identity_ignores_case_and_alias(spark):
    a = names.citation_identity(F.lit("DailyMed"), F.lit("abc-123"), F.lit("warnings"), F.lit(1))
    b = names.citation_identity(F.lit("daily_med"), F.lit("ABC-123"), F.lit("WARNINGS"), F.lit(2))
    assert one(spark, a) == one(spark, b)


def test_identity_keeps_the_case_of_chunk_ids(spark):
    of = lambda chunk: one(spark, names.citation_identity(F.lit("my-src"), F.lit(None).cast("string"), F.lit("x"), F.lit(chunk)))
    assert of("aB-1") == "my-src|chunk|aB-1" != of("ab-1")


def adjusted(spark, base, *held):
    names_ = ("renal_cleared", "hepatic_cleared", "anticoagulant", "pregnancy_risk", "renal_impaired", "renal_severe", "hepatic_impaired", "elderly", "pregnant", "dialysis", "high_inr", "prior_ignored")
    severity, reasons = rules.adjusted_severity(F.lit(base), **{n: F.lit(n in held) for n in names_})
    return one(spark, severity), [tuple(r) for r in one(spark, reasons)]


def test_deltas_of_each_rule(spark):
    assert adjusted(spark, 1) == (1, [])
    assert adjusted(spark, 1, "renal_cleared", "renal_severe", "renal_impaired", "anticoagulant", "high_inr") == (3, [("renal_severe", 2)])
    assert adjusted(spark, 0, "renal_cleared", "renal_impaired", "anticoagulant", "high_inr", "prior_ignored") == (3, [("renal_moderate", 1), ("high_inr_anticoagulant", 2), ("prior_ignored_alert", 1)])
    assert adjusted(spark, 3, "pregnant", "pregnancy_risk", "elderly") == (3, [("elderly", 1), ("pregnancy_contraindicated", 0)])


def test_snippet(spark):
    cut = one(spark, text.snippet(F.lit("x" * 500), 50))
    assert len(cut) <= 52 and cut.endswith("...")
    assert one(spark, text.snippet(F.lit("a \n\t b"))) == "a b"


@pytest.mark.parametrize(
    ("severity", "extra", "urgency"),
    [
        (0, {}, "routine"),
        (2, {}, "priority"),
        (3, {}, "urgent"),
        (2, {"inr": 4.2, "anticoagulant": True}, "critical"),
        (1, {"pregnant": True, "pregnancy_risk": True}, "critical"),
        (2, {"prior_unacknowledged": True}, "urgent"),
    ],
)
def test_urgency(spark, severity, extra, urgency):
    given = {"inr": None, "anticoagulant": False, "pregnant": False, "pregnancy_risk": False, "dialysis": False, "prior_unacknowledged": False} | extra
    columns = {k: F.lit(v).cast("double" if k == "inr" else "boolean") for k, v in given.items()}
    assert one(spark, rules.urgency(F.lit(severity), **columns)) == urgency


def test_destinations_are_in_order_and_once(spark):
    assert one(spark, rules.destinations(F.lit(1), F.lit(True))) == ["log", "patient", "physician", "ehr", "pharmacist"]
    assert one(spark, rules.destinations(F.lit(None).cast("int"), F.lit(None).cast("boolean"))) == ["log"]


@pytest.mark.parametrize(("said", "hours"), [("2 to 4 hours", 4.0), ("about 90 minutes", 1.5), ("1-2 days (24 hours)", 24.0), ("2-3 weeks", 504.0), ("2.345 hours", 2.35), ("6 hrs", None), ("unknown", None)])
def test_half_life(spark, said, hours):
    assert one(spark, numbers.half_life_hours(F.lit(said))) == hours


@pytest.mark.parametrize(("said", "share"), [("High (>90%)", 90.0), ("55 to 65%", 60.0), ("below 10%", 20.0), ("97%", 97.0), ("", None)])
def test_protein_binding(spark, said, share):
    assert one(spark, numbers.protein_binding(F.lit(said))) == share


def test_pair_key_is_symmetric_and_null_safe(spark):
    assert one(spark, numbers.pair_key(F.lit("B"), F.lit("a"))) == one(spark, numbers.pair_key(F.lit("A"), F.lit("b"))) == "a_b"
    assert one(spark, numbers.pair_key(F.lit("B"), F.lit(None).cast("string"))) is None


def test_quotients_are_rounded_as_in_sql(spark):
    """57 of 800 deaths: the product with 10,000 lies under 712.5, though its decimal text is a half."""
    said = [(57, 800), (69, 800), (1, 160), (5, 3), (-1, 10**9), (0, 7), (None, 3)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(said)], "i int, d long, r long")
    got = [r[0] for r in df.orderBy("i").select(numbers.rounded(F.col("d") / F.col("r"), 4)).collect()]
    want = [r[0] for r in duckdb.sql("select round(d / r, 4) from (values " + ", ".join(f"({i}, {'NULL' if d is None else d}, {r})" for i, (d, r) in enumerate(said)) + ") x(i, d, r) order by i").fetchall()]
    assert [str(x) for x in got] == [str(x) for x in want]


def test_a_rate_on_the_half_equals_its_sql(spark):
    pairs = spark.createDataFrame([("x", "y", 800, 57, 5)], "drug_a string, drug_b string, report_count long, death_count long, max_severity int")
    props = spark.createDataFrame([], "drug string, mw double, logp double, binding double, life double, kind string, boxed int, interacts int, known int")
    assert features.paired_figures(pairs, props).first()["death_rate"] == duckdb.sql("select round(57 / 800, 4)").fetchall()[0][0]


def test_age(spark):
    assert one(spark, rules.age_years(F.lit("24"), F.lit("MON"))) == 2
    assert one(spark, rules.age_years(F.lit("999"), F.lit("YR"))) is None
    assert one(spark, rules.age_years(F.lit("x"), F.lit("YR"))) is None


def test_zero_vector(spark):
    assert one(spark, vectors.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


@pytest.mark.parametrize(("reply", "found"), [('```json\n{"a": 1}\n```', '{"a": 1}'), ('so {"a": {"b": 2}} it is', '{"a": {"b": 2}}'), ("none", None)])
def test_json_object(spark, reply, found):
    assert one(spark, text.json_object(F.lit(reply))) == found


def test_names(spark):
    assert one(spark, names.without_dose(F.lit("Aspirin (EC) 81 mg oral tablets"))) == "aspirin tablets"
    assert one(spark, names.without_dose(F.lit("Potassium chloride HCl 25 mEq film-coated"))) == "chloride"
    assert one(spark, names.generic_name(F.lit("Advil 400mg"))) == "ibuprofen"
    assert one(spark, names.generic_name(F.lit("Warfarin 5mg daily"))) == "warfarin"
    assert one(spark, names.without_dose(F.lit("5 mg"))) == "5 mg"
    assert one(spark, text.distinct_ignoring_case(F.array(*map(F.lit, ("A", "b", "a", "B", "c"))))) == ["A", "b", "c"]


def model_sentences(t):
    for word in text.ABBREVIATIONS:
        t = re.sub(rf"\b{word}\.", f"{word}\x01", t)
    return [s for s in (x.strip(" ").replace("\x01", ".") for x in re.sub(r"([.!?])\s+([A-Z])", "\\1\x02\\2", t, flags=re.ASCII).split("\x02")) if s]


def model_chunks(t):
    if len(t) <= 1400:
        return [t] if len(t) >= 80 else []
    done, now = [], []
    for s in model_sentences(t):
        size = sum(map(len, now))
        if now and (size + len(s) > 1400 or size >= 1000):
            done.append(" ".join(now))
            now = now[-1:]
        now = [*now, s]
    if now:
        done.append(" ".join(now))
    return [c for c in done if len(c) >= 80]


def test_chunks_follow_the_model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(text.clean(F.col("text")).alias("t"))
    for row in docs.select("t", text.chunks(F.col("t")).alias("c")).collect():
        assert row["c"] == model_chunks(row["t"])


@pytest.mark.parametrize("t", ["", "x" * 79, "x" * 80, "a" * 1400, "Go on. " * 201, "Dr. Who came. He left." * 90, "y" * 3000])
def test_chunk_limits(spark, t):
    t = t.strip()
    assert one(spark, text.chunks(F.lit(t))) == model_chunks(t)
