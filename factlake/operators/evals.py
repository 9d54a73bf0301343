"""Stored question and answer checks: scores, pass rate, write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replies import judge_score
from ..functions.times import percent
from .memory import last_change

GOAL = 80


def scored(evals: DataFrame) -> DataFrame:
    """Adds ``score`` from the judge's ``verdict``."""
    return evals.withColumn("score", judge_score(F.col("verdict")))


def pass_rates(orgs: DataFrame, scores: DataFrame) -> DataFrame:
    """Pass rate per organisation, null where it has no checks, and the log line of the run."""
    counts = scores.groupBy("org_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") == 1.0).alias("p"))
    total, passed = F.coalesce("n", F.lit(0)), F.coalesce("p", F.lit(0))
    rate = F.when(total > 0, percent(passed, total))
    shown = F.when(rate.isNotNull(), F.concat(
        F.lit("Eval run: "), passed.cast("string"), F.lit("/"), total.cast("string"), F.lit(" passed ("),
        F.format_string("%.1f", rate), F.lit("%). "),
        F.when(rate < GOAL, "⚠️ Below 80% threshold.").otherwise("OK.")))
    return orgs.select("org_id").join(counts, "org_id", "left").select(
        "org_id", total.alias("total"), passed.alias("passed"), rate.alias("pass_rate"), shown.alias("log_line"))


def write_back(evals: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Checks with the score, answer and time of their last run (``id, score, actual``)."""
    new = last_change(results, "id").select("id", F.col("score").alias("new_score"), F.col("actual").alias("new_actual"), F.lit(True).alias("ran"))

    def old(c: str, kind: str) -> Column:
        return F.col(c) if c in evals.columns else F.lit(None).cast(kind)

    return evals.join(new, "id", "left").withColumns({
        "last_score": F.when(F.col("ran"), F.col("new_score")).otherwise(old("last_score", "double")),
        "last_actual_answer": F.when(F.col("ran"), F.col("new_actual")).otherwise(old("last_actual_answer", "string")),
        "last_run_at": F.when(F.col("ran"), now).otherwise(old("last_run_at", "timestamp_ntz")),
    }).drop("new_score", "new_actual", "ran")
