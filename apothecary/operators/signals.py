"""Adverse-event signals: worst outcomes, drug-event pairs and drug-drug co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apothecary.functions.rules import outcome_label, outcome_weight
from apothecary.operators.pairs import in_list


def with_outcome(outcomes: DataFrame, code: str = "code") -> DataFrame:
    return outcomes.withColumn("label", outcome_label(F.col(code))).withColumn("weight", outcome_weight(F.col(code)))


def worst_outcomes(outcomes: DataFrame, report: str = "report") -> DataFrame:
    """report, worst_outcome and max_severity; among equal weights the first label by name."""
    rank = F.struct((-F.col("weight")).alias("w"), "label")
    return with_outcome(outcomes.where(F.col(report).isNotNull())).groupBy(report).agg(F.min_by("label", rank).alias("worst_outcome"), F.max("weight").alias("max_severity"))


def by_report(rows: DataFrame, tasks: int | None) -> DataFrame:
    """Rows that name a report, each report's in one of ``tasks`` tasks; without a number Spark chooses one."""
    return rows.where("report is not null").repartition(*([tasks] if tasks else []), "report")


def drug_event_signal(drugs: DataFrame, events: DataFrame, worst: DataFrame, tasks: int | None = None) -> DataFrame:
    """Reports, mean and greatest severity of each (drug, event); a report without an outcome counts as 1.

    The mean is over all pairs of a drug row with an event row of a report.
    Each report's distinct drugs and events come with their number of rows, so
    a (drug, event) has one row a report and every figure is a partial sum: no
    table of the reports of each pair is kept. ``tasks`` is the number of tasks
    that the reports are dealt to.
    """
    a = by_report(drugs, tasks).groupBy("report", "drug").agg(F.count("*").alias("_a"))
    b = by_report(events, tasks).groupBy("report", "event").agg(F.count("*").alias("_b"))
    severity, n = F.coalesce("max_severity", F.lit(1)), F.col("_a") * F.col("_b")
    rows = a.join(b, "report").join(worst.select("report", "max_severity"), "report", "left")
    found = rows.groupBy("drug", "event").agg(F.count("*").alias("report_count"), F.sum(n * severity).alias("_sum"), F.sum(n).alias("_n"), F.max(severity).alias("max_severity"))
    return found.select("drug", "event", "report_count", (F.col("_sum") / F.col("_n")).alias("avg_severity"), "max_severity")


def pair_cooccurrence(drugs: DataFrame, outcomes: DataFrame, least: int = 5) -> DataFrame:
    """Unordered drug pairs on one report: reports, deaths, hospital stays and greatest severity.

    Deaths count outcome rows, as if those fanned out: they are summed up by
    report first. Pairs are made in the row of a report from its distinct drugs.
    """
    lists = drugs.where("report is not null and drug is not null").groupBy("report").agg(F.array_sort(F.collect_set("drug")).alias("_list"))
    label = F.col("label")
    effects = with_outcome(outcomes).groupBy("report").agg(F.count_if(label == "death").alias("deaths"), F.count_if(label == "hospitalization").alias("stays"), F.max("weight").alias("worst"))
    rows = in_list(lists.where(F.size("_list") > 1).join(effects, "report", "left"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("deaths", "death_count"), ("stays", "hosp_count"))]
    return rows.groupBy("drug_a", "drug_b").agg(F.count("*").alias("report_count"), *sums, F.max("worst").alias("max_severity")).where(F.col("report_count") >= least)
