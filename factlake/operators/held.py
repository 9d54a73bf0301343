"""The review queue over time: what it held is released as reviews free places.

A source is admitted when fewer than ``cap`` items wait before it: those that
waited at first, plus the pending items of the sources before it, less what
reviews have taken out. Both sides only grow, so the review that lets a source
in is the first whose running total reaches a number that the source knows.
Sums and the search for that review run by ranges of (organisation, number), so
an organisation may hold any share of all sources and reviews.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import routing
from .grouping import range_least_after, range_sum_before


def released(held: DataFrame, queue: DataFrame, reviews: DataFrame, cap: int = routing.QUEUE_CAP) -> DataFrame:
    """``org_id, source_id, pending, released_by`` of every held source, in the order of their ids.

    ``held`` has routed candidates (``org_id, source_id, route``), ``queue`` the
    items that waited when they were held (``org_id, waiting``), ``reviews`` what
    each review took out of the queue since (``org_id, review_no, taken``).
    ``released_by`` is the number of the review that let the source in, 0 if
    none was needed, null if it waits still. A review that took nothing lets nothing in.
    """
    pending = held.groupBy("org_id", "source_id").agg(F.count_if(F.col("route") == "pending").alias("pending"))
    ahead = range_sum_before(pending, ["org_id"], ["source_id"], "pending", "ahead")
    waiting = queue.groupBy("org_id").agg(F.sum("waiting").alias("waiting"))
    needs = ahead.join(waiting, "org_id", "left").withColumn(
        "needs", F.greatest(F.coalesce("waiting", F.lit(0)) + F.col("ahead") - cap + 1, F.lit(0)))
    taken = range_sum_before(reviews.filter("taken > 0"), ["org_id"], ["review_no"], "taken", "before").select(
        "org_id", "review_no", (F.col("before") + F.col("taken")).alias("total"))
    # Sources stand before the review that reaches their number.
    none = F.lit(None).cast("bigint")
    line = needs.select("org_id", F.col("needs").alias("number"), F.lit(0).alias("kind"), F.col("source_id").alias("who"), none.alias("review_no"), "pending").unionByName(
        taken.select("org_id", F.col("total").alias("number"), F.lit(1).alias("kind"), F.col("review_no").alias("who"),
                     F.col("review_no").cast("bigint").alias("review_no"), none.alias("pending")))
    found = range_least_after(line, ["org_id"], ["number", "kind", "who"], "review_no", "by").filter("kind = 0")
    return found.select("org_id", F.col("who").alias("source_id"), "pending",
                        F.when(F.col("number") == 0, F.lit(0)).otherwise(F.col("by")).cast("bigint").alias("released_by"))


def replay(held: DataFrame, let_in: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Held candidates as further input of the next batch, and those that wait on; ``let_in`` is ``released``."""
    free = let_in.filter("released_by IS NOT NULL").select("org_id", "source_id")
    keys = ["org_id", "source_id"]
    return (held.join(free, keys, "left_semi").select(*held.columns), held.join(free, keys, "left_anti").select(*held.columns))
