"""Name and pair lookups, searches, alert lists and summaries of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apothecary.functions import records
from apothecary.operators import lookups
from apothecary.sources import xml
from apothecary.sources.tables import table


def property_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    drugs = parts.select("p_brand", F.split("p_name", " ").alias("words"), F.col("p_partkey").alias("seq"))
    keys = lookups.property_keys(drugs, "p_brand", "words", "seq")
    asked = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.split("p_name", " ")[0])
    return parts.select("p_partkey", F.lower(asked).alias("key")).join(keys, "key", "left").select("p_partkey", "key", "kind", "seq")


_PROPERTY_SQL = """
WITH claims AS (SELECT lower(trim(p_brand)) AS key, 0 AS rank, -p_partkey AS place FROM part
  UNION ALL SELECT lower(trim(w)), 1, p_partkey FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)),
k AS (SELECT key, CASE WHEN rank = 0 THEN 'name' ELSE 'synonym' END AS kind, abs(place) AS seq FROM claims WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank, place) = 1),
a AS (SELECT p_partkey, lower(CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_brand ELSE string_split(p_name, ' ')[1] END) AS key FROM part)
SELECT a.p_partkey, a.key, k.kind, k.seq FROM a LEFT JOIN k ON a.key = k.key
"""


def pair_signal_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c, n: F.concat(F.lit(" Drug"), (F.col(c) % n).cast("string"))
    signals = table(spark, sf_dir, "lineitem").select(
        name("l_suppkey", 7).alias("drug_a"), F.upper(name("l_partkey", 9)).alias("drug_b"), F.col("l_quantity").cast("long").alias("report_count"),
        F.col("l_linenumber").cast("long").alias("death_count"), (F.col("l_orderkey") % 4).alias("max_severity"), "l_orderkey", "l_linenumber",
    )
    pairs = table(spark, sf_dir, "part").select("p_partkey", name("p_size", 11).alias("drug_a"), name("p_partkey", 8).alias("drug_b"))
    return lookups.pair_signals(pairs, signals, ["l_orderkey", "l_linenumber"]).drop("drug_a", "drug_b")


_PAIR_SIGNAL_SQL = """
WITH s AS (SELECT least('drug' || l_suppkey % 7, 'drug' || l_partkey % 9) AS a, greatest('drug' || l_suppkey % 7, 'drug' || l_partkey % 9) AS b,
  CAST(l_quantity AS BIGINT) AS report_count, CAST(l_linenumber AS BIGINT) AS death_count, l_orderkey % 4 AS max_severity FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY CAST(l_quantity AS BIGINT) DESC, l_orderkey, l_linenumber) = 1),
p AS (SELECT p_partkey, least('drug' || p_size % 11, 'drug' || p_partkey % 8) AS a, greatest('drug' || p_size % 11, 'drug' || p_partkey % 8) AS b FROM part)
SELECT p_partkey, CAST(s.a IS NOT NULL AS INTEGER) AS seen, coalesce(report_count, 0) AS report_count, coalesce(death_count, 0) AS death_count, coalesce(max_severity, 0) AS max_severity,
  CASE WHEN report_count > 0 THEN round_even(death_count / report_count, 4) ELSE 0.0 END AS death_rate, round_even(ln(1 + coalesce(report_count, 0)), 4) AS signal_strength
FROM p LEFT JOIN s ON p.a = s.a AND p.b = s.b
"""


def label_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "part").select(F.col("p_brand").alias("drug_name"), "p_partkey", (F.col("p_size") % 2 == 0).alias("has_boxed_warn"), (F.col("p_size") % 3 == 0).alias("has_interactions"))
    drugs = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit(" BRAND#"), (F.col("s_suppkey") % 40).cast("string")).alias("drug_name"))
    return lookups.first_flags(drugs, labels, "p_partkey", ["has_boxed_warn", "has_interactions"])


_FLAGS_SQL = """
WITH f AS (SELECT lower(p_brand) AS key, CAST(p_size % 2 = 0 AS INTEGER) AS w, CAST(p_size % 3 = 0 AS INTEGER) AS i FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) = 1)
SELECT s_suppkey, ' BRAND#' || s_suppkey % 40 AS drug_name, coalesce(w, 0) AS has_boxed_warn, coalesce(i, 0) AS has_interactions FROM supplier LEFT JOIN f ON f.key = 'brand#' || s_suppkey % 40
"""


def new_literature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for pairs of severity 2 or more; what they find that was not seen, each document once."""
    pairs = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 4 >= 2).select("c_custkey", records.literature_query(F.lower("c_mktsegment"), F.col("c_name")).alias("query"))
    found = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 997).alias("pmid"), F.col("o_custkey").alias("c_custkey")).join(pairs, "c_custkey")
    seen = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 5).alias("pmid"))
    return lookups.new_documents(found, seen, "pmid", "c_custkey")


_LITERATURE_SQL = """
SELECT o_orderkey % 997 AS pmid, c_custkey, '"' || lower(c_mktsegment) || '"[Title/Abstract] AND "' || c_name || '"[Title/Abstract] AND (interaction OR toxicity OR adverse)' AS query
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 4 >= 2 AND o_orderkey % 997 NOT IN (SELECT s_suppkey * 5 FROM supplier)
QUALIFY row_number() OVER (PARTITION BY o_orderkey % 997 ORDER BY c_custkey) = 1
"""

#: A library of evidence for the query: drugs, score and id.
_LIBRARY = [(("small", "economy"), 0.95, "E1"), (("widget", "standard"), 0.91, "E2"), (("cold", "promo"), 0.97, "E3"), (("brand#1", "e"), 0.6, "E4"), (("gadget", "large"), 0.45, "E5"), (("o", "a"), 0.7, "E6")]


def library_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lookups.library_matches([F.split("p_name", " ")[0], F.col("p_type")], _LIBRARY, most=3)
    return table(spark, sf_dir, "part").select("p_partkey", F.size(hits).alias("n_hits"), F.array_join(hits, ",").alias("hits"))


def _library_sql() -> str:
    entries = ", ".join(f"({list(names)!r}, {score}, '{key}')" for names, score, key in _LIBRARY)
    fits = lambda d: f"len(list_filter(names, lambda n: contains(n, {d}) OR contains({d}, n))) > 0"
    return f"""
WITH e(names, score, key) AS (VALUES {entries}),
q AS (SELECT p_partkey, lower(string_split(p_name, ' ')[1]) AS a, lower(p_type) AS b FROM part),
m AS (SELECT p_partkey, score, key FROM q, e WHERE score >= 0.5 AND {fits("a")} AND {fits("b")} QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC) <= 3)
SELECT q.p_partkey, CAST(count(m.key) AS INTEGER) AS n_hits, coalesce(string_agg(m.key, ',' ORDER BY m.score DESC), '') AS hits FROM q LEFT JOIN m ON q.p_partkey = m.p_partkey GROUP BY q.p_partkey
"""


def cited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("l_returnflag") == "A", "FDA").when(F.col("l_returnflag") == "N", "PubMed").when(F.col("l_linenumber") % 2 == 0, "FAERS").otherwise("Other")
    chunks = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 4).alias("severity"), (F.col("l_quantity") / 50).alias("score"), source.alias("source"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lookups.cited(chunks, "l_orderkey", "severity", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], top_k=1)


_CITED_SQL = """
WITH c AS (SELECT l_orderkey, l_quantity / 50 AS score, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 2 WHEN l_linenumber % 2 = 0 THEN 1 ELSE 3 END AS place,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS depth FROM lineitem WHERE l_quantity / 50 >= 0.5),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, place ORDER BY depth) AS number, row_number() OVER (PARTITION BY l_orderkey ORDER BY place, depth) AS pos FROM c WHERE depth <= 1 + l_orderkey % 4)
SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n_cited, max(CASE WHEN pos = 1 THEN score END) AS top_score, max(CASE WHEN pos = 1 THEN score END) >= 0.75 AS confident,
  string_agg((['FDA', 'FAERS', 'PUB', 'REF'])[place + 1] || '-' || number, ',' ORDER BY pos) AS keys FROM k GROUP BY l_orderkey
"""


def session_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each session the alerts of severity 2 or more and all errors (as severity 0), gravest and surest first."""
    error = F.col("o_orderkey") % 17 == 0
    alerts = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(error, 0).otherwise(F.col("o_orderkey") % 4).cast("int").alias("final_severity"), F.when(error, 0).otherwise(F.floor("o_totalprice") % 100).cast("int").alias("confidence"), error.alias("failed"))
    kept = alerts.where((F.col("final_severity") >= 2) | F.col("failed"))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("final_severity"), F.desc("confidence"), "o_orderkey")))


_SESSION_SQL = """
WITH a AS (SELECT o_custkey, o_orderkey, o_orderkey % 17 = 0 AS failed, CAST(CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_orderkey % 4 END AS INTEGER) AS final_severity,
  CAST(CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) % 100 END AS INTEGER) AS confidence FROM orders)
SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY final_severity DESC, confidence DESC, o_orderkey) AS INTEGER) AS place FROM a WHERE final_severity >= 2 OR failed
"""


def recent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 alerts in any state."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").cast("string").alias("sent")).orderBy(F.desc("sent"), F.desc("o_orderkey")).limit(50)


_RECENT_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS sent FROM orders ORDER BY sent DESC, o_orderkey DESC LIMIT 50"


def active_medications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each patient the active entries in the order they were added."""
    entry = F.struct(F.col("o_orderdate").alias("added"), "o_orderkey")
    listed = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.sort_array(F.collect_list(entry)).alias("_entries"))
    return listed.select("o_custkey", F.size("_entries").alias("n_active"), F.array_join(F.transform("_entries", lambda x: x["o_orderkey"].cast("string")), ",").alias("entries"))


_ACTIVE_SQL = "SELECT o_custkey, CAST(count(*) AS INTEGER) AS n_active, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS entries FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey"


def medication_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prescriptions read from a line of text, and the laboratory values that a profile takes."""
    size = F.col("p_size").cast("string")
    said = F.when(F.col("p_partkey") % 5 == 0, " ").when(F.col("p_partkey") % 5 == 1, F.col("p_type")).when(F.col("p_partkey") % 5 == 2, F.concat("p_type", F.lit("  "), size, F.lit("mg"))).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" twice "), size))
    labs = F.create_map(F.lit("egfr"), size, F.lit("INR"), size, F.lit("inr"), F.when(F.col("p_size") % 2 == 0, size), F.lit("alt"), F.when(F.col("p_size") % 3 == 0, F.lit("high")).otherwise(size))
    patch = F.array_sort(F.map_entries(records.lab_patch(labs)))
    rows = table(spark, sf_dir, "part").select("p_partkey", said.alias("said"), patch.alias("patch"))
    shown = F.array_join(F.transform("patch", lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int").cast("string"))), ",")
    return rows.select("p_partkey", *[c.alias(n) for n, c in records.medication_parts(F.col("said")).items()], shown.alias("patch"))


_MEDICATION_SQL = """
WITH r AS (SELECT *, CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN p_type WHEN 2 THEN p_type || '  ' || p_size || 'mg' ELSE ' ' || p_name || ' twice ' || p_size END AS said FROM part),
w AS (SELECT *, list_filter(string_split_regex(said, '\\s+'), lambda x: x <> '') AS words FROM r)
SELECT p_partkey, coalesce(words[1], said) AS drug_name, words[2] AS dose, CASE WHEN len(words) > 2 THEN array_to_string(words[3:], ' ') END AS frequency,
  concat_ws(',', CASE WHEN p_size % 3 <> 0 THEN 'alt=' || p_size END, 'egfr=' || p_size, CASE WHEN p_size % 2 = 0 THEN 'inr=' || p_size END) AS patch FROM w
"""


def resolved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drugs to check: those given, else those read from a picture, else those of the profile."""
    key = F.col("c_custkey")
    lists = {"given": F.when(key % 3 == 0, F.array("c_mktsegment")), "image": F.when(key % 2 == 0, F.array("c_name", "c_mktsegment")).otherwise(F.array().cast("array<string>")), "profile": F.when(key % 7 != 0, F.array("c_name"))}
    chosen, origin = records.first_filled(**lists)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(chosen, "|").alias("drugs"), origin.alias("origin"))


_RESOLVED_SQL = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN c_name || '|' || c_mktsegment WHEN c_custkey % 7 <> 0 THEN c_name ELSE '' END AS drugs,
  CASE WHEN c_custkey % 3 = 0 THEN 'given' WHEN c_custkey % 2 = 0 THEN 'image' WHEN c_custkey % 7 <> 0 THEN 'profile' ELSE 'none' END AS origin FROM customer
"""


def step_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind of step the runs that passed and failed, and the time spent."""
    failed = F.col("value") < 20
    spent = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(~failed).alias("passed"), F.count_if(failed).alias("failed"), spent.alias("seconds"), F.count_if(failed).__eq__(0).alias("ok"))


_STEPS_SQL = """
SELECT event_type, count(*) FILTER (WHERE NOT value < 20) AS passed, count(*) FILTER (WHERE value < 20) AS failed, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS seconds, count(*) FILTER (WHERE value < 20) = 0 AS ok
FROM events GROUP BY event_type
"""


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by year, by outcome and by (source, language), one table."""
    of = lambda df, kind, value: df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    orders, docs = table(spark, sf_dir, "orders"), table(spark, sf_dir, "documents")
    years = of(orders, "year", F.year("o_orderdate").cast("string"))
    return years.unionByName(of(orders, "outcome", F.col("o_orderstatus"))).unionByName(of(docs, "section", F.concat_ws("/", "source", "lang")))


_HISTOGRAM_SQL = """
SELECT 'year' AS kind, CAST(year(o_orderdate) AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT 'outcome', o_orderstatus, count(*) FROM orders GROUP BY ALL UNION ALL SELECT 'section', concat_ws('/', source, lang), count(*) FROM documents GROUP BY ALL
"""


def name_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    brands = parts.select(F.lower("p_brand").alias("name"), F.col("p_partkey").alias("seq"))
    words = parts.select(F.explode(F.split("p_name", " ")).alias("name"), F.col("p_partkey").alias("seq"))
    segments = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("name"), F.col("c_custkey").alias("seq"))
    return lookups.ordered_union(words, segments, brands)


_UNION_SQL = """
WITH n AS (SELECT unnest(string_split(p_name, ' ')) AS name, 0 AS table_no, p_partkey AS seq FROM part UNION ALL SELECT lower(c_mktsegment), 1, c_custkey FROM customer UNION ALL SELECT lower(p_brand), 2, p_partkey FROM part)
SELECT name, table_no, seq FROM n WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY table_no, seq) = 1
"""


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three figures with the greatest mean size, found in one pass over the rows."""
    columns = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    means = table(spark, sf_dir, "lineitem").agg(*[F.avg(F.abs(F.col(c).cast("decimal(18,2)"))).cast("double").alias(c) for c in columns])
    listed = F.sort_array(F.array(*[F.struct(F.round(c, 4).alias("mean_size"), F.lit(c).alias("feature")) for c in columns]), asc=False)
    return means.select(F.inline(F.slice(listed, 1, 3))).select("feature", "mean_size")


_CONTRIBUTION_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(CAST(sum(abs(CAST({c} AS DECIMAL(18, 2)))) AS DOUBLE) / count({c}), 4) AS mean_size FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"))

#: Object identifiers of code systems in the labels of ``label_codes``.
_SYSTEMS = ("2.16.840.1.113883.6.69", "2.16.840.1.113883.4.9")


def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of two systems in a label of each part: nested, repeated, empty, absent and of other systems."""
    code = lambda value, system: F.concat(F.lit('<code code="'), value, F.lit(f'" codeSystem="{system}"/>'))
    brand, size = F.col("p_brand"), F.col("p_size").cast("string")
    product = F.concat(F.lit('<product xmlns="urn:x">'), code(F.concat(F.lit("N"), size), _SYSTEMS[0]), F.lit("<part>"), code(brand, _SYSTEMS[0]), code(brand, _SYSTEMS[0]), F.lit("</part></product>"))
    other = F.concat(code(size, _SYSTEMS[1] + "9"), F.when(F.col("p_size") % 2 == 0, code(size, _SYSTEMS[1])).otherwise(code(F.lit(""), _SYSTEMS[1])), F.lit(f'<code codeSystem="{_SYSTEMS[1]}"/>'))
    document = F.when(F.col("p_partkey") % 9 != 0, F.concat(F.lit('<?xml version="1.0"?><document>'), product, other, F.lit("</document>")))
    return table(spark, sf_dir, "part").select("p_partkey", *[F.array_join(xml.system_codes(document, s), ",").alias(n) for n, s in zip(("ndc", "unii"), _SYSTEMS, strict=True)])


_CODES_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE array_to_string(list_sort(list_distinct(['N' || p_size, p_brand])), ',') END AS ndc, CASE WHEN p_partkey % 9 <> 0 AND p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS unii FROM part
"""

QUERIES = {
    "q96_label_codes": label_codes,
    "q76_property_lookup": property_lookup,
    "q77_pair_signal_lookup": pair_signal_lookup,
    "q78_label_flags": label_flags,
    "q79_new_literature": new_literature,
    "q80_library_evidence": library_evidence,
    "q81_cited_evidence": cited_evidence,
    "q82_session_alerts": session_alerts,
    "q83_recent_alerts": recent_alerts,
    "q84_active_medications": active_medications,
    "q85_medication_records": medication_records,
    "q86_resolved_lists": resolved_lists,
    "q87_step_summary": step_summary,
    "q88_histograms": histograms,
    "q89_name_union": name_union,
    "q90_contributions": contributions,
}
SQL = {
    "q96_label_codes": _CODES_SQL,
    "q76_property_lookup": _PROPERTY_SQL,
    "q77_pair_signal_lookup": _PAIR_SIGNAL_SQL,
    "q78_label_flags": _FLAGS_SQL,
    "q79_new_literature": _LITERATURE_SQL,
    "q80_library_evidence": _library_sql(),
    "q81_cited_evidence": _CITED_SQL,
    "q82_session_alerts": _SESSION_SQL,
    "q83_recent_alerts": _RECENT_SQL,
    "q84_active_medications": _ACTIVE_SQL,
    "q85_medication_records": _MEDICATION_SQL,
    "q86_resolved_lists": _RESOLVED_SQL,
    "q87_step_summary": _STEPS_SQL,
    "q88_histograms": _HISTOGRAM_SQL,
    "q89_name_union": _UNION_SQL,
    "q90_contributions": f"SELECT * FROM ({_CONTRIBUTION_SQL}) ORDER BY mean_size DESC LIMIT 3",
}
