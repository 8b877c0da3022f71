"""Adverse-event analytics and stores over orders (reports), lineitem with part (drugs) and supplier nations (events)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.functions.numbers import pair_key
from apothecary.operators import dedup, pairs, signals, stores
from apothecary.operators.tasks import tasks_for
from apothecary.sources.tables import table

_CODE_SQL = "CASE l_returnflag WHEN 'A' THEN 'DE' WHEN 'R' THEN 'HO' ELSE 'OT' END"
_WEIGHT_SQL = "CASE l_returnflag WHEN 'A' THEN 5 WHEN 'R' THEN 3 ELSE 1 END"
_LABEL_SQL = "CASE l_returnflag WHEN 'A' THEN 'death' WHEN 'R' THEN 'hospitalization' ELSE 'other' END"


def drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return items.join(parts, items.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("report"), F.col("p_name").alias("drug"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("l_returnflag") == "A", "DE").when(F.col("l_returnflag") == "R", "HO").otherwise("OT")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report"), code.alias("code"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, suppliers, nations = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    joined = items.join(suppliers, items.l_suppkey == suppliers.s_suppkey).join(F.broadcast(nations), suppliers.s_nationkey == nations.n_nationkey)
    return joined.select(F.col("l_orderkey").alias("report"), F.col("n_name").alias("event"))


def pair_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.pair_cooccurrence(drugs(spark, sf_dir), outcomes(spark, sf_dir))


_PAIRS_SQL = f"""
WITH d AS (SELECT DISTINCT l_orderkey AS report, p_name AS drug FROM lineitem JOIN part ON l_partkey = p_partkey),
     o AS (SELECT l_orderkey AS report, {_LABEL_SQL} AS label, {_WEIGHT_SQL} AS weight FROM lineitem)
SELECT a.drug AS drug_a, b.drug AS drug_b, count(DISTINCT a.report) AS report_count,
  count(*) FILTER (label = 'death') AS death_count, count(*) FILTER (label = 'hospitalization') AS hosp_count, max(weight) AS max_severity
FROM d a JOIN d b ON a.report = b.report AND a.drug < b.drug LEFT JOIN o ON o.report = a.report
GROUP BY 1, 2 HAVING count(DISTINCT a.report) >= 5
"""


def drug_event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = tasks_for(table(spark, sf_dir, "lineitem"))
    worst = signals.worst_outcomes(signals.by_report(outcomes(spark, sf_dir), tasks))
    return signals.drug_event_signal(drugs(spark, sf_dir), events(spark, sf_dir), worst, tasks)


_EVENTS_SQL = f"""
WITH d AS (SELECT l_orderkey AS report, p_name AS drug FROM lineitem JOIN part ON l_partkey = p_partkey),
     e AS (SELECT l_orderkey AS report, n_name AS event FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
     w AS (SELECT l_orderkey AS report, max({_WEIGHT_SQL}) AS sev FROM lineitem GROUP BY 1)
SELECT drug, event, count(DISTINCT d.report) AS report_count, avg(coalesce(sev, 1)) AS avg_severity, max(coalesce(sev, 1)) AS max_severity
FROM d JOIN e USING (report) LEFT JOIN w USING (report) GROUP BY 1, 2
"""


def worst_outcome_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report"), F.col("o_custkey").alias("case_id"))
    return reports.join(signals.worst_outcomes(outcomes(spark, sf_dir)), "report", "left")


_WORST_SQL = f"""
SELECT o_orderkey AS report, o_custkey AS case_id, w.worst_outcome, w.max_severity FROM orders LEFT JOIN
 (SELECT l_orderkey AS report, arg_min({_LABEL_SQL}, {{'w': -({_WEIGHT_SQL}), 'l': {_LABEL_SQL}}}) AS worst_outcome, max({_WEIGHT_SQL}) AS max_severity FROM lineitem GROUP BY 1) w
 ON w.report = o_orderkey
"""


def latest_case_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    version = F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double")
    return dedup.latest_version(orders, "o_custkey", version, F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


_LATEST_SQL = """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1
"""


def symmetric_pair_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("a"), F.col("l_suppkey").cast("string").alias("b"), F.col("l_orderkey").alias("seq"))
    return dedup.one_of_each_pair(rows, "a", "b", [F.col("seq"), F.col("a"), F.col("b")])


_SYMMETRIC_SQL = """
WITH r AS (SELECT CAST(l_partkey AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b, l_orderkey AS seq FROM lineitem)
SELECT a, b, seq FROM r QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY seq, a, b) = 1
"""


def _pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = items.join(parts, items.l_partkey == parts.p_partkey)
    return rows.select(pair_key(F.col("p_name"), F.col("p_brand")).alias("pair_key"), F.col("l_quantity").cast("int").alias("severity"), F.col("l_shipmode" if "l_shipmode" in items.columns else "l_linestatus").alias("description"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), (F.col("l_orderkey") % 2 == 0).alias("old"))


def upsert_max_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pair_rows(spark, sf_dir).withColumn("description", F.concat("description", F.col("seq").cast("string")))
    columns = ["pair_key", "severity", "description", "seq"]
    return stores.upsert_greatest(rows.where("old").select(*columns), rows.where("not old").select(*columns), "pair_key", "severity", "description", "seq")


_UPSERT_MAX_SQL = """
SELECT least(lower(p_name), lower(p_brand)) || '_' || greatest(lower(p_name), lower(p_brand)) AS pair_key,
  CAST(max(l_quantity) AS INTEGER) AS severity, arg_max(l_linestatus || (l_orderkey * 100 + l_linenumber), l_orderkey * 100 + l_linenumber) AS description
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
"""


def upsert_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return stores.upsert_last(orders.where("o_orderstatus <> 'F'"), orders.where("o_orderstatus = 'F'"), ["o_custkey"], "o_orderkey")


_UPSERT_LAST_SQL = """
SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1
"""


def replace_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lit(True).alias("active"), "o_orderpriority")
    new = orders.where("o_orderpriority like '1%'").drop("active")
    lists = stores.replace_list(orders.where("o_orderpriority not like '1%'"), new, "o_custkey")
    return lists.select("o_custkey", "o_orderkey", "active")


_REPLACE_SQL = """
WITH new AS (SELECT * FROM orders WHERE o_orderpriority LIKE '1%')
SELECT o_custkey, o_orderkey, o_custkey NOT IN (SELECT o_custkey FROM new) AS active FROM orders WHERE o_orderpriority NOT LIKE '1%'
UNION ALL SELECT o_custkey, o_orderkey, true FROM new
"""


def pair_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    known = parts.groupBy("p_name", "p_brand").agg(F.max("p_size").alias("severity"))
    asked = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.upper("p_brand").alias("x"), F.col("p_name").alias("y")).distinct()
    return pairs.lookup(asked, known, "x", "y", ["severity"], "p_name", "p_brand")


_LOOKUP_SQL = """
WITH k AS (SELECT least(lower(p_name), lower(p_brand)) AS a, greatest(lower(p_name), lower(p_brand)) AS b, max(p_size) AS severity FROM part GROUP BY p_name, p_brand),
     m AS (SELECT a, b, min(severity) AS severity FROM k GROUP BY 1, 2),
     q AS (SELECT DISTINCT upper(p_brand) AS x, p_name AS y FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT x, y, severity FROM q LEFT JOIN m ON a = least(lower(x), lower(y)) AND b = greatest(lower(x), lower(y))
"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items, parts = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    return orders.join(items, orders.o_orderkey == items.l_orderkey).join(parts, items.l_partkey == parts.p_partkey).select("o_custkey", "o_orderkey", "o_orderstatus", "p_name")


def basket_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.combinations(_lists(spark, sf_dir), "o_orderkey", "p_name")


_COMBINATIONS_SQL = """
WITH d AS (SELECT DISTINCT o_orderkey, p_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)
SELECT a.o_orderkey, a.p_name AS drug_a, b.p_name AS drug_b FROM d a JOIN d b ON a.o_orderkey = b.o_orderkey AND a.p_name < b.p_name
"""


def proactive_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _lists(spark, sf_dir).withColumn("fresh", F.coalesce(F.col("o_orderstatus") == "O", F.lit(False)))
    tasks = tasks_for(table(spark, sf_dir, "lineitem"))
    return pairs.sweep_marked(marked, "o_custkey", "p_name", "fresh", tasks).groupBy("drug_a", "drug_b").agg(F.count("*").alias("n_owners"))


_SWEEP_SQL = """
WITH l AS (SELECT DISTINCT o_custkey, o_orderstatus = 'O' AS fresh, p_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
     p AS (SELECT DISTINCT a.o_custkey, least(a.p_name, b.p_name) AS drug_a, greatest(a.p_name, b.p_name) AS drug_b
           FROM l a JOIN l b ON a.o_custkey = b.o_custkey AND a.p_name <> b.p_name WHERE a.fresh)
SELECT drug_a, drug_b, count(*) AS n_owners FROM p GROUP BY 1, 2
"""


def membership_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a flag for having been sold in a returned line, and the never-sold ones by anti join."""
    parts, items = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    returned = items.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(1))
    unsold = parts.join(items, parts.p_partkey == items.l_partkey, "left_anti").select("p_partkey", F.lit(1).alias("unsold"))
    return parts.join(returned, "p_partkey", "left").join(unsold, "p_partkey", "left").select("p_partkey", F.coalesce("hit", F.lit(0)).alias("returned"), F.coalesce("unsold", F.lit(0)).alias("unsold"))


_MEMBERSHIP_SQL = """
SELECT p_partkey, CAST(p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS INTEGER) AS returned,
  CAST(p_partkey NOT IN (SELECT l_partkey FROM lineitem) AS INTEGER) AS unsold FROM part
"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.table_counts({t: table(spark, sf_dir, t) for t in _TABLES})


def union_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quarter's reports, united by name, with columns that only some quarters have."""
    orders = table(spark, sf_dir, "orders").withColumn("quarter", F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")))
    first = orders.where("quarter(o_orderdate) <= 2").select("quarter", "o_orderkey", "o_totalprice")
    second = orders.where("quarter(o_orderdate) > 2").select("quarter", "o_orderkey", "o_orderstatus")
    return first.unionByName(second, allowMissingColumns=True)


_QUARTERS_SQL = """
SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, o_orderkey,
  CASE WHEN quarter(o_orderdate) <= 2 THEN o_totalprice END AS o_totalprice, CASE WHEN quarter(o_orderdate) > 2 THEN o_orderstatus END AS o_orderstatus FROM orders
"""


def narrative_top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each drug with its five most reported events."""
    signal = drug_event_signal(spark, sf_dir)
    top = dedup.top_k(signal, ["drug"], [F.desc("report_count"), F.col("event")], 5)
    listed = F.array_sort(F.collect_list(F.struct("rank", "event", "report_count")))
    line = F.array_join(F.transform(listed, lambda e: F.concat(e["event"], F.lit(" ("), e["report_count"].cast("string"), F.lit(")"))), ", ")
    return top.groupBy("drug").agg(F.concat(F.col("drug"), F.lit(": "), line).alias("narrative"))


_NARRATIVE_SQL = f"""
WITH s AS ({_EVENTS_SQL}), t AS (SELECT *, row_number() OVER (PARTITION BY drug ORDER BY report_count DESC, event) AS r FROM s QUALIFY r <= 5)
SELECT drug, drug || ': ' || string_agg(event || ' (' || report_count || ')', ', ' ORDER BY r) AS narrative FROM t GROUP BY drug
"""

QUERIES = {
    "q01_pair_cooccurrence": pair_cooccurrence,
    "q02_drug_event_signal": drug_event_signal,
    "q03_worst_outcome_report": worst_outcome_report,
    "q04_latest_case_version": latest_case_version,
    "q05_symmetric_pair_dedup": symmetric_pair_dedup,
    "q06_upsert_max_severity": upsert_max_severity,
    "q07_upsert_last_write": upsert_last_write,
    "q08_replace_list": replace_list,
    "q09_pair_lookup": pair_lookup,
    "q10_basket_combinations": basket_combinations,
    "q11_proactive_sweep": proactive_sweep,
    "q12_membership_flags": membership_flags,
    "q13_table_counts": table_counts,
    "q14_union_quarters": union_quarters,
    "q20_narrative_top_events": narrative_top_events,
}
SQL = {
    "q01_pair_cooccurrence": _PAIRS_SQL,
    "q02_drug_event_signal": _EVENTS_SQL,
    "q03_worst_outcome_report": _WORST_SQL,
    "q04_latest_case_version": _LATEST_SQL,
    "q05_symmetric_pair_dedup": _SYMMETRIC_SQL,
    "q06_upsert_max_severity": _UPSERT_MAX_SQL,
    "q07_upsert_last_write": _UPSERT_LAST_SQL,
    "q08_replace_list": _REPLACE_SQL,
    "q09_pair_lookup": _LOOKUP_SQL,
    "q10_basket_combinations": _COMBINATIONS_SQL,
    "q11_proactive_sweep": _SWEEP_SQL,
    "q12_membership_flags": _MEMBERSHIP_SQL,
    "q13_table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in _TABLES),
    "q14_union_quarters": _QUARTERS_SQL,
    "q20_narrative_top_events": _NARRATIVE_SQL,
}
