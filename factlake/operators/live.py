"""Live path from model replies to stored facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import context, ingest, replies, routing, search
from .grouping import group_ordinal, id_slice

def item_number() -> Column:
    """60 bits of a hash of ``org_id, source_id, pos``: one rule for all items, and no two organisations share numbers.

    It says nothing about order: ``source_id, pos`` does.
    """
    return F.conv(F.substring(F.md5(F.concat_ws("/", "org_id", "source_id", "pos")), 1, 15), 16, 10).cast("bigint")


def proposals(extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates and edges of extraction replies (``org_id, source_id, reply``).

    ``seq`` names a candidate in its organisation; their order is ``source_id, pos``.
    """
    parsed = replies.parse_extractions(extractions)
    candidates = replies.explode_entities(parsed, "org_id", "source_id").select(
        item_number().alias("seq"), "org_id", "source_id", "pos", "entity_type", "name", "content")
    return candidates, replies.explode_edges(parsed, "source_id").drop("pos")


def scored(candidates: DataFrame, critic_replies: DataFrame) -> DataFrame:
    """Candidates with their verdicts; ``critic_replies`` has ``seq, reply``, and ``org_id`` where organisations may share source ids."""
    on = [c for c in ("org_id", "seq") if c in critic_replies.columns]
    verdicts = replies.critic_verdicts(critic_replies).select(*on, "approved", "confidence_score", "critic_reason")
    return candidates.join(verdicts, on)


def resembling(new: DataFrame, entities: DataFrame, k: int = 5, include_self: bool = False) -> DataFrame:
    """Nearest facts of each new one among those stored before it, with their text.

    ``new`` and ``entities`` carry ``embedding``; new facts have ``id, seq``, and
    ``pos`` where their order is ``source_id, pos``.
    """
    if "pos" in new.columns:
        new = group_ordinal(new, ["org_id"], [id_slice("source_id")], routing.arrival(new), "seq_").withColumn("seq", F.col("seq_")).drop("seq_")
    cols = ["id", "org_id", "entity_type", "name", "content", "source_id", "embedding"]
    old = search.searchable(entities).select(*cols, F.lit(-1).cast("bigint").alias("seq"))
    pool = old.unionByName(new.select(*cols, "seq"))
    limit = F.col("seq") + (1 if include_self else 0)
    asked = new.select("org_id", F.col("id").alias("query_id"), F.col("embedding").alias("vector"), limit.alias("seq"))
    return context.hits_with_facts(search.top_k_many(asked, pool, ["org_id"], k, "seq", "seq"), pool)


def contradictions(
    candidates: DataFrame, entities: DataFrame, embed: Callable[[DataFrame], DataFrame],
    check: Callable[[DataFrame], DataFrame], id_base: int = 0, keep: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Review items for new facts that contradict older ones.

    Looked for among all facts the batch could store: those past the queue cap
    come after the crossing and do not move it. ``embed`` adds ``embedding`` to
    rows with ``content``; ``check`` turns facts with their ``fact_block`` into
    ``query_id, reply``. ``keep`` stores the new facts, their neighbours and the
    notes, each of which is read more than once.
    """
    keep = keep or (lambda df, _: df)
    approved = routing.route(candidates).filter("route = 'approved'")
    new = keep(embed(routing.new_entities(approved, entities).withColumn("id", F.lit(id_base) + F.col("seq"))), "new_facts")
    hits = keep(resembling(new, entities), "neighbours")
    blocks = context.fact_blocks(new.select(F.col("id").alias("query_id"), "org_id", "content"), hits)
    asked = blocks.filter(F.col("fact_block") != context.NO_HITS)
    verdicts = replies.contradiction_verdicts(check(asked)).withColumnRenamed("query_id", "id")
    return keep(context.contradiction_notes(new, hits, verdicts), "notes")


def store_replies(
    extractions: DataFrame, critic_replies: DataFrame, entities: DataFrame, queue: DataFrame, *,
    notes: DataFrame | None = None, id_base: int = 0, keep: Callable[[DataFrame, str], DataFrame] | None = None,
) -> ingest.Sinks:
    """Every sink of a batch of extraction and critic replies."""
    candidates, edges = proposals(extractions)
    return ingest.store_batch(scored(candidates, critic_replies), edges, entities, queue,
                              contradictions=notes, id_base=id_base, keep=keep)
