"""Patient rules and alert routing over customer (patients), orders (prior alerts) and events (alert log)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.functions import rules
from apothecary.operators import dedup
from apothecary.sources.tables import table

_PATIENT_SQL = """
p AS (SELECT c_custkey, c_acctbal / 100 AS egfr, (c_custkey % 200) * 1.0 AS ast, (c_custkey % 150) * 1.0 AS alt, 20 + c_custkey % 75 AS age, (c_custkey % 50) / 10.0 AS inr,
  c_mktsegment = 'MACHINERY' AS pregnant, c_mktsegment = 'BUILDING' AS dialysis, c_nationkey % 2 = 0 AS renal_cleared, c_nationkey % 3 = 0 AS hepatic_cleared, c_nationkey % 4 = 0 AS anticoagulant,
  c_nationkey % 5 = 0 AS pregnancy_risk, CAST(c_custkey % 4 AS INTEGER) AS base, c_custkey % 7 = 0 AS prior_ignored FROM customer)
"""


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation, segment = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 100).alias("egfr"), (key % 200).cast("double").alias("ast"), (key % 150).cast("double").alias("alt"), (20 + key % 75).alias("age"), ((key % 50) / 10.0).alias("inr"),
        (segment == "MACHINERY").alias("pregnant"), (segment == "BUILDING").alias("dialysis"), (nation % 2 == 0).alias("renal_cleared"), (nation % 3 == 0).alias("hepatic_cleared"), (nation % 4 == 0).alias("anticoagulant"),
        (nation % 5 == 0).alias("pregnancy_risk"), (key % 4).cast("int").alias("base"), (key % 7 == 0).alias("prior_ignored"),
    )


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patients(spark, sf_dir).withColumns(rules.patient_flags(*map(F.col, ("egfr", "ast", "alt", "age", "inr"))))


_FLAGS_SQL = "egfr < 60 AS renal_impaired, egfr < 30 AS renal_severe, ast > 120 OR alt > 120 AS hepatic_impaired, age >= 75 AS elderly, inr > 3.0 AS bleeding_risk"


def patient_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).select("c_custkey", "renal_impaired", "renal_severe", "hepatic_impaired", "elderly", "bleeding_risk")


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("renal_cleared", "hepatic_cleared", "anticoagulant", "pregnancy_risk", "renal_impaired", "renal_severe", "hepatic_impaired", "elderly", "pregnant", "dialysis", "prior_ignored")
    severity, reasons = rules.adjusted_severity(F.col("base"), high_inr=F.col("bleeding_risk"), **{n: F.col(n) for n in names})
    return _flagged(spark, sf_dir).withColumn("severity", severity).withColumn("reasons", reasons)


def adjust_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjusted(spark, sf_dir).select("c_custkey", "base", "severity", F.array_join(F.transform("reasons", lambda r: F.concat(r["rule"], F.lit(" +"), r["delta"].cast("string"))), ",").alias("reasons"))


_ADJUST_SQL = f"""
{_PATIENT_SQL}, f AS (SELECT *, {_FLAGS_SQL} FROM p),
a AS (SELECT *, renal_cleared AND renal_severe AS r1, renal_cleared AND renal_impaired AND NOT renal_severe AS r2, hepatic_cleared AND hepatic_impaired AS r3, elderly AS r4, anticoagulant AND bleeding_risk AS r5,
  pregnancy_risk AND pregnant AS r6, renal_cleared AND dialysis AS r7, prior_ignored AS r8 FROM f),
d1 AS (SELECT *, CASE WHEN r1 THEN greatest(0, 3 - base) END AS d1 FROM a),
d5 AS (SELECT *, base + coalesce(d1, 0) + r2::INT + r3::INT + r4::INT AS s4, CASE WHEN r5 AND s4 < 3 THEN 3 - s4 END AS d5 FROM d1),
d6 AS (SELECT *, s4 + coalesce(d5, 0) AS s5, CASE WHEN r6 THEN greatest(0, 3 - s5) END AS d6 FROM d5),
d7 AS (SELECT *, s5 + coalesce(d6, 0) AS s6, CASE WHEN r7 THEN greatest(0, 3 - s6) END AS d7 FROM d6),
s AS (SELECT *, CAST(least(3, s6 + coalesce(d7, 0) + r8::INT) AS INTEGER) AS severity FROM d7)
"""


def urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = rules.urgency(F.col("severity"), inr=F.col("inr"), anticoagulant=F.col("anticoagulant"), pregnant=F.col("pregnant"), pregnancy_risk=F.col("pregnancy_risk"), dialysis=F.col("dialysis"), prior_unacknowledged=F.col("prior_ignored"))
    return _adjusted(spark, sf_dir).select("c_custkey", "severity", level.alias("urgency"))


_URGENCY_SQL = """, u AS (SELECT *, CASE WHEN (inr > 3.5 AND anticoagulant) OR (pregnant AND pregnancy_risk) OR (dialysis AND severity >= 3) THEN 'critical'
  WHEN prior_ignored THEN CASE WHEN severity >= 2 THEN 'urgent' ELSE 'priority' END WHEN severity >= 3 THEN 'urgent' WHEN severity = 2 THEN 'priority' ELSE 'routine' END AS urgency FROM s)"""


def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = rules.destinations(F.col("severity"), F.col("urgency") == "critical")
    return urgency(spark, sf_dir).select("c_custkey", F.array_join(places, ",").alias("routed_to"))


_ROUTE_SQL = """ SELECT c_custkey, CASE severity WHEN 0 THEN 'log' || CASE WHEN urgency = 'critical' THEN ',physician,ehr,pharmacist,patient' ELSE '' END
  WHEN 1 THEN 'log,patient' || CASE WHEN urgency = 'critical' THEN ',physician,ehr,pharmacist' ELSE '' END
  WHEN 2 THEN 'log,patient,pharmacist' || CASE WHEN urgency = 'critical' THEN ',physician,ehr' ELSE '' END ELSE 'log,patient,pharmacist,physician,ehr' END AS routed_to FROM u"""

_SEVERITY = {"click": 0, "view": 0, "signup": 1, "purchase": 2, "error": 3}
_ALERTS_SQL = """
alerts AS (SELECT event_id, user_id, ts, value, event_type, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 0 END AS severity,
  CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 1 AS acknowledged FROM events)
"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in _SEVERITY.items() for x in item]), F.col("event_type")), F.lit(0))
    read = F.coalesce(F.get_json_object("props", "$.k").try_cast("long") % 2 == 1, F.lit(False))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type", level.alias("severity"), read.alias("acknowledged"))


def alert_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unread alerts of severity 2 or more with their place in the user's inbox: gravest and newest first."""
    unread = alerts(spark, sf_dir).where("not acknowledged and severity >= 2")
    return dedup.ranked(unread, ["user_id"], [F.desc("severity"), F.desc("ts"), F.col("event_id")], "place").select("user_id", "event_id", "severity", "place")


_INBOX_SQL = f"""WITH {_ALERTS_SQL} SELECT user_id, event_id, severity, row_number() OVER (PARTITION BY user_id ORDER BY severity DESC, ts DESC, event_id) AS place
FROM alerts WHERE NOT acknowledged AND severity >= 2"""


def last_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest alerts of each user, and the oldest five of those as one list."""
    newest = dedup.top_k(alerts(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"])
    grouped = newest.groupBy("user_id").agg(listed.alias("ids"))
    return grouped.select("user_id", F.size("ids").alias("n_alerts"), F.array_join(F.slice("ids", F.greatest(F.lit(1), F.size("ids") - 4), 5), ",").alias("oldest_five"))


_LAST_SQL = f"""WITH {_ALERTS_SQL}, t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM alerts QUALIFY r <= 10),
l AS (SELECT user_id, list(event_id ORDER BY r) AS ids FROM t GROUP BY 1)
SELECT user_id, len(ids) AS n_alerts, array_to_string(ids[greatest(1, len(ids) - 4):], ',') AS oldest_five FROM l"""


def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerts(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return rows.groupBy("user_id", "day").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("severity") >= 2).alias("n_alerts"), F.count_if(F.col("severity") >= 3).alias("n_critical"), F.max("severity").alias("worst"))


_ROLLUP_SQL = f"""WITH {_ALERTS_SQL} SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_pairs, count(*) FILTER (severity >= 2) AS n_alerts, count(*) FILTER (severity >= 3) AS n_critical, max(severity) AS worst
FROM alerts GROUP BY 1, 2"""


def lab_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("egfr")
    return patients(spark, sf_dir).select("c_custkey", rules.lab_flag(value, F.lit(30.0), F.lit(60.0), F.lit(0.0), F.lit(90.0)).alias("flag"))


_LAB_SQL = f"WITH {_PATIENT_SQL} SELECT c_custkey, CASE WHEN egfr <= 0 THEN 'CRIT LOW' WHEN egfr >= 90 THEN 'CRIT HIGH' WHEN egfr < 30 THEN 'LOW' WHEN egfr > 60 THEN 'HIGH' WHEN egfr IS NOT NULL THEN 'normal' END AS flag FROM p"


def provider_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, successes and their mean value by provider."""
    ok = F.col("value") >= 20
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("provider")).agg(F.count("*").alias("n_requests"), F.count_if(ok).alias("n_ok"), F.round(F.coalesce(F.avg(F.when(ok, F.col("value"))), F.lit(0.0)), 6).alias("mean_value"))


_PROVIDER_SQL = "SELECT event_type AS provider, count(*) AS n_requests, count(*) FILTER (value >= 20) AS n_ok, round(coalesce(avg(value) FILTER (value >= 20), 0.0), 6) AS mean_value FROM events GROUP BY 1"


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of each event type: the batch form of the streaming rollup."""
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"))


_WINDOW_SQL = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2"

QUERIES = {
    "q34_patient_flags": patient_flags,
    "q35_adjust_severity": adjust_severity,
    "q36_urgency": urgency,
    "q37_routing": routing,
    "q38_alert_inbox": alert_inbox,
    "q39_last_alerts": last_alerts,
    "q40_session_rollup": session_rollup,
    "q42_lab_flags": lab_flags,
    "q55_provider_stats": provider_stats,
    "x01_event_windows": event_windows,
}
SQL = {
    "q34_patient_flags": f"WITH {_PATIENT_SQL} SELECT c_custkey, {_FLAGS_SQL} FROM p",
    "q35_adjust_severity": f"WITH {_ADJUST_SQL} SELECT c_custkey, base, severity, concat_ws(',', 'renal_severe +' || d1, CASE WHEN r2 THEN 'renal_moderate +1' END, CASE WHEN r3 THEN 'hepatic_impaired +1' END, CASE WHEN r4 THEN 'elderly +1' END, 'high_inr_anticoagulant +' || d5, 'pregnancy_contraindicated +' || d6, 'dialysis +' || d7, CASE WHEN r8 THEN 'prior_ignored_alert +1' END) AS reasons FROM s",
    "q36_urgency": f"WITH {_ADJUST_SQL}{_URGENCY_SQL} SELECT c_custkey, severity, urgency FROM u",
    "q37_routing": f"WITH {_ADJUST_SQL}{_URGENCY_SQL}{_ROUTE_SQL}",
    "q38_alert_inbox": _INBOX_SQL,
    "q39_last_alerts": _LAST_SQL,
    "q40_session_rollup": _ROLLUP_SQL,
    "q42_lab_flags": _LAB_SQL,
    "q55_provider_stats": _PROVIDER_SQL,
    "x01_event_windows": _WINDOW_SQL,
}
