"""Alerts from a stream of events, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.functions import rules


def read_events(spark: SparkSession, path: str, schema: str = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string") -> DataFrame:
    """A stream of Parquet files; ``ts`` as an instant, which watermarks ask for."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def routed(events: DataFrame, severity: dict[str, int]) -> DataFrame:
    """Events with a severity and the destinations it goes to, row by row."""
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in severity.items() for x in item]), F.col("event_type")), F.lit(0))
    return events.withColumn("severity", level).withColumn("routed_to", rules.destinations(F.col("severity"), F.lit(False)))


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts of each event type by hour; rows later than ``late`` behind the newest are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n_events"), F.approx_count_distinct("user_id").alias("n_users"))
    return grouped.select(F.col("window.start").alias("hour"), "event_type", "n_events", "n_users")


def once_per_event(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, as long as its repeats come within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
