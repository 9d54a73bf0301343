"""Heartbeats of recurring processes: latest state, overdue check, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: expected minutes between two beats of each process
REGISTRY = {
    "daily_briefings": 1440,
    "daily_ingestion": 1440,
    "micro_batch": 30,
    "backfill_processor": 2,
    "evals": 43200,
    "slack_health": 1440,
}
GRACE = 1.5


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGISTRY.items()), "process_name string, interval_min int")


def latest_beats(beats: DataFrame) -> DataFrame:
    """Last beat of each process; ``beats`` has ``event_id, process_name, beat_at, status, error``."""
    last = F.max_by(F.struct("beat_at", "status", "error"), F.struct("beat_at", "event_id"))
    return beats.groupBy("process_name").agg(last.alias("b")).select(
        "process_name", F.col("b.beat_at").alias("last_beat_at"), F.col("b.status").alias("last_status"),
        F.col("b.error").alias("last_error"))


def apply_beats(stored: DataFrame, beats: DataFrame, registered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New heartbeat table, and the names of beats no one registered."""
    known = beats.join(registered.select("process_name"), "process_name", "left_semi")
    old = stored.select(
        F.lit(-1).cast("bigint").alias("event_id"), "process_name", F.col("last_beat_at").alias("beat_at"),
        F.col("last_status").alias("status"), F.col("last_error").alias("error"))
    table = latest_beats(old.unionByName(known.select(*old.columns))).join(registered, "process_name", "left").withColumnRenamed(
        "interval_min", "expected_interval_minutes")
    unknown = beats.select("process_name").distinct().join(registered.select("process_name"), "process_name", "left_anti")
    return table, unknown.withColumn("error", F.concat(F.lit("Unknown process '"), "process_name", F.lit("'.")))


def check_all(registered: DataFrame, latest: DataFrame, now: Column) -> DataFrame:
    """State of every registered process; overdue past one and a half intervals, or if never seen."""
    late = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_beat_at").cast("timestamp")) - (
        F.col("interval_min") * GRACE * 60_000_000).cast("bigint")
    overdue = F.coalesce(late > 0, F.lit(True))
    return registered.join(latest, "process_name", "left").select(
        F.col("process_name").alias("process"), "last_beat_at",
        F.when(F.col("last_beat_at").isNull(), "never_run").otherwise(F.col("last_status")).alias("last_status"),
        F.when(F.col("last_beat_at").isNotNull(), F.col("last_error")).alias("last_error"),
        F.col("interval_min").alias("expected_interval_minutes"), overdue.alias("overdue"),
        F.when(overdue, F.floor(late / 60_000_000)).cast("bigint").alias("overdue_by_minutes"),
    )


def alert_lines(checked: DataFrame) -> DataFrame:
    by = F.when(F.coalesce("overdue_by_minutes", F.lit(0)) == 0, "never run").otherwise(
        F.concat(F.col("overdue_by_minutes").cast("string"), F.lit(" min past deadline")))
    line = F.concat(
        F.lit("OVERDUE: "), "process", F.lit(" | "), by, F.lit(" | expected every "),
        F.col("expected_interval_minutes").cast("string"), F.lit(" min | last beat: "),
        F.coalesce(F.date_format("last_beat_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("never")),
        F.lit(" | last status: "), "last_status",
        F.when(F.coalesce("last_error", F.lit("")) != "", F.concat(F.lit(" | error: "), "last_error")).otherwise(""),
    )
    return checked.filter("overdue").select("process", line.alias("alert"))


def health(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.when(F.bool_or("overdue"), "degraded").otherwise("ok").alias("status"),
        F.count_if(~F.col("overdue")).alias("ok_processes"), F.count_if(F.col("overdue")).alias("overdue_processes"),
    )
