"""Gate in front of agent tasks: memory first, beliefs second, then the task itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouping import fresh_keys

# fixed values
NO_MEMORY = "No relevant memory found. Cannot act without verified facts. Please add relevant memory first."
UNKNOWN_TASK = "Unknown task type. Use 'draft' or 'flag'."


def gate_tasks(tasks: DataFrame, hits: DataFrame, beliefs: DataFrame, belief_verdicts: DataFrame,
               checks: DataFrame, drafts: DataFrame) -> DataFrame:
    """Result of each task (``query_id, org_id, task_type``).

    ``hits`` are search hits, ``beliefs`` the active belief facts. Verdicts,
    checks and drafts are replies by ``query_id``; an organisation without
    beliefs cannot be in conflict.
    """
    # Several verdicts for one task count as one: blocked if any belief is in the way.
    belief_verdicts = belief_verdicts.groupBy("query_id").agg(
        F.bool_or("conflict").alias("conflict"), F.min(F.when(F.col("conflict"), F.col("belief"))).alias("belief"))
    found = hits.groupBy("query_id").agg(F.count("*").alias("memory_used"))
    guarded = fresh_keys(beliefs.select("org_id").distinct(), "org_id").withColumn("guarded", F.lit(True))
    conflict = F.coalesce(F.col("guarded") & F.col("conflict"), F.lit(False))
    reason = F.when(F.col("memory_used").isNull(), NO_MEMORY).when(
        conflict, F.concat(F.lit("Action blocked by Belief: "), "belief"))
    done = (
        F.when(F.col("task_type") == "draft", F.col("draft"))
        .when((F.col("task_type") == "flag") & F.col("contradiction"),
              F.concat(F.lit("CONTRADICTION DETECTED: "), F.coalesce("check_reason", F.lit(""))))
        .when(F.col("task_type") == "flag",
              F.concat(F.lit("No contradiction found. "), F.coalesce("check_reason", F.lit(""))))
        .otherwise(UNKNOWN_TASK)
    )
    joined = (
        tasks.join(found, "query_id", "left").join(guarded, "org_id", "left")
        .join(belief_verdicts.select("query_id", "conflict", "belief"), "query_id", "left")
        .join(checks.select("query_id", "contradiction", F.col("reason").alias("check_reason")), "query_id", "left")
        .join(drafts.select("query_id", "draft"), "query_id", "left")
        .withColumn("block_reason", F.coalesce(reason, F.lit("")))
    )
    blocked = F.col("block_reason") != ""
    return joined.select(
        "query_id", "org_id", "task_type", F.coalesce("memory_used", F.lit(0)).alias("memory_used"),
        blocked.alias("blocked"), "block_reason",
        F.when(blocked, F.concat(F.lit("BLOCKED: "), "block_reason")).otherwise(done).alias("result"),
    )
