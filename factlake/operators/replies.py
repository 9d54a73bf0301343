"""Model replies as rows: extraction, batches, verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies as R


def parse_extractions(replies: DataFrame, key: str = "source_id") -> DataFrame:
    """Adds the lists ``entities`` and ``relationships``, empty where the reply is unusable."""
    value = replies.withColumn("value_", R.parsed(F.col("reply")))
    return value.withColumns({
        "entities": R.list_member(F.col("value_"), "$.entities", R.ENTITY),
        "relationships": R.list_member(F.col("value_"), "$.relationships", R.EDGE),
    }).drop("value_")


def explode_entities(parsed: DataFrame, *keys: str) -> DataFrame:
    return parsed.select(*keys, F.posexplode("entities").alias("pos", "e")).select(*keys, "pos", "e.*")


def explode_edges(parsed: DataFrame, *keys: str) -> DataFrame:
    rows = parsed.select(*keys, F.posexplode("relationships").alias("pos", "r")).select(*keys, "pos", "r.*")
    return rows.withColumn("relationship_type", F.coalesce("relationship_type", F.lit("related_to")))


def unpack_batches(replies: DataFrame) -> DataFrame:
    """One row per position of each batch; ``replies`` has ``batch_id, n, reply``.

    The last item of a position wins, a position without one gets empty lists.
    All of it happens inside the row, so nothing is shuffled.
    """
    items = F.coalesce(
        F.try_variant_get(R.parsed(F.col("reply")), "$", "array<variant>"), F.array().cast("array<variant>")
    )
    found = F.transform(items, lambda v: F.struct(
        F.try_variant_get(v, "$.message_index", "bigint").alias("at"),
        R.list_member(v, "$.entities", R.ENTITY).alias("entities"),
        R.list_member(v, "$.relationships", R.EDGE).alias("relationships"),
    ))
    positions = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n").cast("int") - 1))
    nothing = F.struct(
        F.lit(None).cast("bigint").alias("at"), F.array().cast(f"array<{R.ENTITY}>").alias("entities"),
        F.array().cast(f"array<{R.EDGE}>").alias("relationships"),
    )
    # Wrapped in a list of one, the items are bound to a name and read once per row.
    picked = F.transform(F.array(found), lambda items_: F.transform(positions, lambda i: F.coalesce(
        F.try_element_at(F.filter(items_, lambda f: f["at"] == i), F.lit(-1)), nothing)))
    return (
        replies.select("batch_id", F.posexplode(picked.getItem(0)).alias("idx", "p"))
        .select("batch_id", "idx", "p.entities", "p.relationships")
    )


def attach_sources(unpacked: DataFrame, packed: DataFrame) -> DataFrame:
    """Batch positions with the source that was packed there."""
    return packed.join(unpacked, ["org_id", "batch_no", "idx"])


def _judged(replies: DataFrame, col: str, verdict: Callable[[Column], Column]) -> DataFrame:
    """Replies with the members of their verdict.

    The verdict passes through a generator of one row: a later filter on it is
    then not pushed below, where it would repeat the parsing in its condition.
    """
    parsed = replies.withColumn("value_", R.parsed(F.col(col)))
    return parsed.select(*replies.columns, F.inline_outer(F.array(verdict(F.col("value_")))))


def critic_verdicts(replies: DataFrame) -> DataFrame:
    return _judged(replies, "reply", R.critic_verdict).withColumnRenamed("reason", "critic_reason")


def contradiction_verdicts(replies: DataFrame, col: str = "reply") -> DataFrame:
    return _judged(replies, col, R.contradiction_verdict)


def belief_verdicts(replies: DataFrame, col: str = "belief_reply") -> DataFrame:
    return _judged(replies, col, R.belief_verdict)
