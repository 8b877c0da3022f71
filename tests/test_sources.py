"""Readers on small files written by the tests."""

import pytest
from pyspark.sql import functions as F

from apothecary.operators import signals
from apothecary.sources import reports, tables, xml
from apothecary.streaming import alerts

DRUGS = """<drugbank xmlns="http://x"><drug type="biotech"><drugbank-id>BTD1</drugbank-id><drugbank-id primary="true">DB1</drugbank-id><name>Alpha</name>
<groups><group>approved</group></groups><synonyms><synonym language="en">A-1</synonym></synonyms>
<drug-interactions><drug-interaction><drugbank-id>DB2</drugbank-id><name>Beta</name><description>Severe bleeding.</description></drug-interaction></drug-interactions>
<calculated-properties><property><kind>logP</kind><value>n/a</value></property><property><kind>logP</kind><value>1.5</value></property></calculated-properties>
<enzymes><enzyme><name>Cytochrome P450 CYP 2C9</name><actions><action>inhibitor/substrate</action></actions></enzyme></enzymes></drug>
<drug type="small molecule"><drugbank-id>X</drugbank-id><name>NoPrimary</name></drug></drugbank>"""
LABEL = """<document xmlns="urn:hl7-org:v3"><setId root="S1"/><title>Alpha tablets</title><component><section><code code="34066-1"/><text>{a}</text>
<section><code code="34084-4"/><text>{b}</text></section></section><section><code code="34066-1"/><text>{a}</text></section><section><code code="9"/><text>{a}</text></section></component></document>"""
ARTICLES = """<s><PubmedArticle><MedlineCitation><PMID Version="1">7</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>1999 Jan</MedlineDate></PubDate></JournalIssue></Journal>
<ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label="AIM">a</AbstractText><AbstractText>b</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID Version="1">8</PMID><Article><ArticleTitle>T</ArticleTitle></Article></MedlineCitation></PubmedArticle></s>"""


def test_drugs(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DRUGS)
    drugs = xml.read_drugs(spark, str(tmp_path / "d.xml"))
    assert [(r["drug_id"], r["name"], r["logp"], r["synonyms"]) for r in drugs.collect()] == [("DB1", "Alpha", 1.5, ["A-1"])]
    assert [(r["drug_b"], r["severity"]) for r in xml.interactions(drugs).collect()] == [("Beta", 3)]
    assert sorted((r["enzyme"], r["role"]) for r in xml.enzyme_roles(drugs).collect()) == [("CYP2C9", "inhibitor"), ("CYP2C9", "substrate")]


def test_labels(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "l.xml").write_text(LABEL.format(a="warning " * 10, b="reaction " * 10))
    (tmp_path / "in" / "bad.xml").write_text("<document")
    got = {r["section"]: r["text"] for r in xml.read_labels(spark, str(tmp_path)).collect()}
    assert set(got) == {"boxed_warning", "adverse_reactions"}
    assert got["boxed_warning"].count("\n\n") == 1 and "reaction" in got["boxed_warning"]


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(ARTICLES)
    assert [(r["pmid"], r["abstract"], r["year"]) for r in xml.read_articles(spark, str(tmp_path / "a.xml")).collect()] == [("7", "AIM: a b", "1999")]


def test_report_quarters(spark, tmp_path):
    for quarter, header in (("2023Q4", "PRIMARYID$CASEID$CASEVERSION$AGE$AGE_COD"), ("2024Q1", "ISR$CASE$AGE$AGE_COD")):
        (tmp_path / quarter).mkdir()
        line = "1$c$2$30$YR\n2$c$10$24$MON\n$c$11$1$YR" if "Q4" in quarter else "3$d$999$YR"
        (tmp_path / quarter / "DEMO.txt").write_text(f"{header}\n{line}\n", encoding="latin-1")
    (tmp_path / "2023Q4" / "DRUG.txt").write_text("primaryid$role_cod$drugname\n1$PS$ caf\xe9  x \n1$C$skip\n", encoding="latin-1")
    raw = reports.read_reports(spark, [str(tmp_path / q / "DEMO.txt") for q in ("2023Q4", "2024Q1")])
    got = sorted((r["report"], r["age_years"], r["quarter"]) for r in reports.demographics(raw).collect())
    assert [(a, c) for a, _, c in got] == [("2", "2023Q4"), ("3", "2024Q1")] and got[0][1] == 2 and got[1][1] is None
    assert [tuple(r) for r in reports.drugs(reports.read_reports(spark, [str(tmp_path / "2023Q4" / "DRUG.txt")])).collect()] == [("1", "CAF\xc9 X")]


def test_missing_columns_and_tables(spark, tmp_path):
    assert tables.read_if_exists(spark, str(tmp_path / "none"), "a int").collect() == []
    with pytest.raises(ValueError, match="no column"):
        tables.resolve_columns(spark.range(1), {"report": ["primaryid"]}, required=("report",))


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = spark.range(100).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600).cast("timestamp_ntz").alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    stream = alerts.hourly(alerts.read_events(spark, str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert spark.sql("select sum(n_events), count(*) from hourly").first() == (100, 17)
    routed = alerts.routed(rows, {"error": 3})
    assert routed.select("routed_to").first()[0][-1] == "ehr"
    assert signals.with_outcome(spark.createDataFrame([("de",)], "code string")).first()["label"] == "death"


def test_quarters_are_found_and_bad_files_are_told(spark, tmp_path):
    def put(path, content):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content, encoding="latin-1")

    put("2023q4/DEMO23Q4.txt", "primaryid$ CaseID $age\n1$10$50\n")
    put("2023q4/Drug23Q4.txt", "primaryid$drugname$role_cod\n1$OLD$PS\n")
    put("2023q4/drug23q4.csv", "primaryid$drugname$role_cod\n1$NEW$PS\n")
    put("2023q4/reac23q4.txt", "pt\nRash\n")
    put("2024Q1/demo24q1.txt", "isr$case$gndr_cod\n2$20$F\n")
    put("2024Q1/demo_again.txt", "isr$case\n9$90\n")
    put("2024Q1/demo.csv", "isr$case\n8$80\n")
    put("2024Q1/outc24q1.txt", "\n\n")
    put("2024Q1/drug24q1.txt", "")
    put("2024Q1/readme.txt", "no table")
    put("2024Q5/demo.txt", "primaryid\n5\n")
    put("old 2022Q1/demo.txt", "primaryid\n6\n")
    found = {(r["quarter"], r["kind"], r["path"].rsplit("/", 1)[1]) for r in reports.discover_quarters(spark, str(tmp_path)).collect()}
    assert found == {("2023Q4", "demo", "DEMO23Q4.txt"), ("2023Q4", "drug", "drug23q4.csv"), ("2023Q4", "reac", "reac23q4.txt"), ("2024Q1", "demo", "demo24q1.txt"), ("2024Q1", "outc", "outc24q1.txt")}
    tables_, failed = reports.read_quarters(spark, str(tmp_path))
    assert set(tables_) == {"demo", "drug"}
    assert sorted((r["report"], r["case_id"], r["quarter"]) for r in reports.demographics(tables_["demo"]).collect()) == [("1", "10", "2023Q4"), ("2", "20", "2024Q1")]
    assert [r["drug"] for r in reports.drugs(tables_["drug"]).collect()] == ["NEW"]
    told = {(r["quarter"], r["kind"]): r["reason"] for r in failed.collect()}
    assert told.pop(("2023Q4", "reac")) == "no report number" and told.pop(("2024Q1", "outc")) == "no header"
    assert told == {(q, k): "missing or empty" for q, k in (("2023Q4", "outc"), ("2023Q4", "indi"), ("2024Q1", "drug"), ("2024Q1", "reac"), ("2024Q1", "indi"))}


def test_codes_of_a_system(spark):
    text = '<d xmlns="urn:hl7-org:v3"><code code="b" codeSystem="1.2"/><x><code code="a" codeSystem="1.2" /><code code="b" codeSystem="1.2"/></x><code code="c" codeSystem="1.20"/><y codeSystem="1.2"/></d>'
    rows = spark.createDataFrame([(1, text), (2, None), (3, "<d/>")], "id int, text string")
    assert {r["id"]: r["codes"] for r in rows.select("id", xml.system_codes(F.col("text"), "1.2").alias("codes")).collect()} == {1: ["a", "b"], 2: [], 3: []}
    with pytest.raises(ValueError, match="no object identifier"):
        xml.system_codes(F.col("text"), "1.2' or '1")
