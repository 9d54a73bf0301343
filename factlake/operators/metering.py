"""Token metering, backfill progress and status counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import half_up, percent
from .memory import active_facts
from .requests import HISTORY

# fixed values
BUDGET = 500_000


def usage(events: DataFrame) -> DataFrame:
    """Tokens per organisation and month."""
    return events.groupBy("org_id", "month").agg(F.sum("tokens").alias("tokens_used"))


def with_budget(totals: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Totals with the limit of their organisation and month, the default where none is stored."""
    default = F.lit(BUDGET).cast("bigint")
    if limits is None:
        return totals.withColumn("budget_limit", default)
    own = limits.groupBy("org_id", "month").agg(F.max("budget_limit").cast("bigint").alias("own_limit"))
    return totals.join(own, ["org_id", "month"], "left").withColumn("budget_limit", F.coalesce("own_limit", default)).drop("own_limit")


def add_usage(stored: DataFrame, events: DataFrame) -> DataFrame:
    """Counters with new tokens added; the limit of a known row stays."""
    rows = stored.select("org_id", "month", "tokens_used", "budget_limit").unionByName(
        usage(events).withColumn("budget_limit", F.lit(None).cast("bigint")))
    return rows.groupBy("org_id", "month").agg(
        F.sum("tokens_used").alias("tokens_used"),
        F.coalesce(F.max("budget_limit"), F.lit(BUDGET)).cast("bigint").alias("budget_limit"),
    )


def budget_state(orgs: DataFrame, stored: DataFrame, month: str) -> DataFrame:
    """Whether each organisation has used up the month; false without a row."""
    rows = stored.filter(F.col("month") == month)
    return orgs.select("org_id").join(rows, "org_id", "left").select(
        "org_id", F.coalesce(F.col("tokens_used") >= F.col("budget_limit"), F.lit(False)).alias("over_budget"))


def usage_summary(orgs: DataFrame, stored: DataFrame, month: str) -> DataFrame:
    rows = stored.filter(F.col("month") == month).drop("month")
    used = F.coalesce("tokens_used", F.lit(0)).cast("bigint")
    limit = F.coalesce("budget_limit", F.lit(BUDGET)).cast("bigint")
    return orgs.select("org_id").join(rows, "org_id", "left").select(
        "org_id", F.lit(month).alias("month"), used.alias("tokens_used"), limit.alias("budget_limit"),
        F.coalesce(F.col("tokens_used") >= F.col("budget_limit"), F.lit(False)).alias("over_budget"),
        F.when(limit > 0, half_up(used / limit * 100)).otherwise(0).cast("bigint").alias("used_percent"),
    )


def backfill_progress(orgs: DataFrame, sources: DataFrame) -> DataFrame:
    counts = sources.filter(F.col("source_type") == HISTORY).groupBy("org_id").agg(
        F.count("*").alias("total"), F.count("processed_at").alias("processed"))
    total, done = F.coalesce("total", F.lit(0)), F.coalesce("processed", F.lit(0))
    return orgs.select("org_id").join(counts, "org_id", "left").select(
        "org_id", total.alias("total_backfill_sources"), done.alias("processed"), (total - done).alias("remaining"),
        F.when(total > 0, percent(done, total)).otherwise(100.0).alias("percent_complete"),
    )


def pending_counts(pending: DataFrame) -> DataFrame:
    return pending.groupBy("org_id").agg(F.count("*").alias("pending_count"))


def fact_counts(facts: DataFrame) -> DataFrame:
    return active_facts(facts).groupBy("org_id").agg(F.count("*").alias("total_memories"))


def status_cards(
    orgs: DataFrame, facts: DataFrame, pending: DataFrame, beats: DataFrame, connections: DataFrame
) -> DataFrame:
    """Status per organisation; ``connections`` has ``org_id, access_token`` of the mailbox, unique by org.

    Everything is counted per organisation before it is joined.
    """
    last = beats.filter(F.col("process_name") == "micro_batch").agg(F.max("last_beat_at").alias("t")).select("t").scalar()
    linked = connections.groupBy("org_id").agg(F.bool_or(F.col("access_token").isNotNull()).alias("linked"))
    return (
        orgs.select("org_id").join(linked, "org_id", "left").join(fact_counts(facts), "org_id", "left")
        .join(pending_counts(pending), "org_id", "left")
        .select(
            "org_id", F.coalesce("linked", F.lit(False)).alias("gmail_connected"), last.alias("last_sync_at"),
            F.coalesce("total_memories", F.lit(0)).alias("total_memories"),
            F.coalesce("pending_count", F.lit(0)).alias("pending_count"),
        )
    )
