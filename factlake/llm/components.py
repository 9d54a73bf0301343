"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).collect()[0]
    return tuple(row)


EDGES_PER_FILE = 1_000_000


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of ``edges`` (``a``, ``b``).

    Alternates large stars and small stars: every node hands its neighbours to
    the smallest of them, until each component is a star around its smallest
    node. A node's neighbours are never gathered; a round is two aggregates and
    two joins, and the number of rounds grows with the logarithm of the size.
    """
    current = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), name)
    before = _digest(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("hub")).agg(F.least(F.first("a"), F.min("b")).alias("least"))
        large = (both.join(least, both["a"] == least["hub"]).filter("b > a AND b != least")
                 .select(F.col("b").alias("a"), F.col("least").alias("b")))
        least = large.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("least"))
        joined = large.join(least, large["a"] == least["hub"])
        small = joined.select("a", F.col("least").alias("b")).unionByName(
            joined.filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct()
        # Few files for few edges: a round reads them several times.
        current = stored(small.coalesce(8 + before[0] // EDGES_PER_FILE), name)
        after = _digest(current)
        if after == before:
            break
        before = after
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
