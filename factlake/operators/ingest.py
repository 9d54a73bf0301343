"""Storing a batch of scored candidates: every sink from one routed table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import routing

STORED_BY = "coo_critic"


@dataclass
class Sinks:
    """Rows to add to each table. ``edges``, ``paused`` and ``held`` are None on the backfill path.

    ``held`` has the candidates of sources that met a full queue, as they came:
    they are given to ``store_batch`` again once the queue has room.
    """

    entities: DataFrame
    nodes: DataFrame
    pending: DataFrame
    rejected: DataFrame
    edges: DataFrame | None = None
    paused: DataFrame | None = None
    held: DataFrame | None = None


def _entities(new: DataFrame, id_base: int) -> DataFrame:
    return new.select(
        (F.lit(id_base) + F.col("seq")).cast("bigint").alias("id"), "org_id", "entity_type", "name", "content", "source_id",
        F.lit(STORED_BY).alias("approved_by"), F.lit("active").alias("status"), "seq",
    )


def _nodes(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("id").alias("entity_id"), "org_id", "entity_type", F.coalesce("name", F.lit("")).alias("name"), "content", "seq")


def _pending(rows: DataFrame) -> DataFrame:
    return rows.select(
        "org_id", "source_id", "seq", "entity_type", "name", "content", F.coalesce("critic_reason", F.lit("")).alias("critic_reason"),
        "confidence_score", F.lit("standard").alias("review_type"),
    )


def store_batch(
    candidates: DataFrame, edges: DataFrame, entities: DataFrame, queue: DataFrame, *,
    contradictions: DataFrame | None = None, id_base: int = 0, keep: Callable[[DataFrame, str], DataFrame] | None = None,
    threshold: float = routing.LIVE_THRESHOLD, cap: int | None = routing.QUEUE_CAP,
) -> Sinks:
    """Live path: route, stop at a full queue, store the first of each name, wire edges.

    ``candidates`` has ``seq, org_id, source_id, entity_type, name, content,
    approved, confidence_score, critic_reason``; ``seq`` grows with
    ``source_id``, or ``pos`` is the place in it. ``queue`` has the items already waiting per organisation.
    ``contradictions`` are review rows (``org_id, source_id, …``) found for the
    stored facts; they fill the queue too, and with the ``id`` of their fact they
    are put in it. ``keep`` stores a table under a name
    and returns it as stored; with it the two tables that several sinks read are
    computed once.
    """
    keep = keep or (lambda df, _: df)
    routed = keep(routing.route(candidates, threshold), "routed")
    pending = routing.pending_per_source(routed)
    if contradictions is not None:
        extra = contradictions.groupBy("org_id", "source_id").agg(F.count("*").alias("pending"))
        pending = pending.unionByName(extra).groupBy("org_id", "source_id").agg(F.sum("pending").alias("pending"))
    # Without a cap nothing waits.
    cutoffs = routing.queue_cutoffs(pending, queue, cap) if cap is not None else pending.select(
        "org_id", F.col("source_id").alias("last_source")).limit(0)
    flagged = routing.admit(routed, cutoffs)
    kept = flagged.filter("admitted").drop("admitted")
    approved = kept.filter("route = 'approved'")
    new = keep(_entities(routing.new_entities(approved, entities), id_base), "new_entities")
    waiting = _pending(kept.filter("route = 'pending'"))
    if contradictions is not None and "id" in contradictions.columns:
        notes = routing.admit(contradictions, cutoffs).filter("admitted").join(new.select("id", "seq"), "id")
        waiting = waiting.unionByName(notes.select(*waiting.columns))
    return Sinks(
        entities=new, nodes=_nodes(new), pending=waiting,
        rejected=routing.rejection_logs(kept.filter("route = 'rejected'")),
        edges=routing.resolve_edges(edges, approved, new, entities), paused=routing.pause_logs(flagged),
        held=flagged.filter("NOT admitted").select(*candidates.columns),
    )


def store_backfill(candidates: DataFrame, entities: DataFrame, *, id_base: int = 0) -> Sinks:
    """Backfill path: higher threshold, no cap, no edges, log lines without the reason."""
    routed = routing.route(candidates, routing.BACKFILL_THRESHOLD)
    new = _entities(routing.new_entities(routed.filter("route = 'approved'"), entities), id_base)
    return Sinks(
        entities=new, nodes=_nodes(new), pending=_pending(routed.filter("route = 'pending'")),
        rejected=routing.rejection_logs(routed.filter("route = 'rejected'"), with_reason=False),
    )


def as_rows(sinks: Sinks) -> DataFrame:
    """All sinks as one table with the name of the sink, for checks and reports."""
    none = F.lit(None).cast("bigint")

    def rows(df: DataFrame, sink: str, first, key, content: str) -> DataFrame:
        return df.select(F.lit(sink).alias("sink"), "org_id", first.alias("source_id"), key.alias("key"), F.col(content).alias("content"))

    out = [
        rows(sinks.entities, "entity", F.col("source_id"), F.col("id"), "content"),
        rows(sinks.nodes, "node", F.col("entity_id"), F.col("entity_id"), "content"),
        rows(sinks.pending, "pending", F.col("source_id"), F.col("seq"), "content"),
        rows(sinks.rejected, "log", F.col("source_id"), F.col("seq"), "content"),
    ]
    if sinks.edges is not None:
        out.append(rows(sinks.edges, "edge", F.col("from_id"), F.col("to_id"), "relationship_type"))
    if sinks.held is not None:
        out.append(rows(sinks.held, "held", F.col("source_id"), F.col("seq"), "content"))
    if sinks.paused is not None:
        out.append(rows(sinks.paused, "log", F.col("source_id"), none, "content"))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def keep_under(base: str) -> Callable[[DataFrame, str], DataFrame]:
    """A ``keep`` that writes to ``base``, which must be a folder shared by all executors."""

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{base}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{base}/{name}")

    return keep


def write(sinks: Sinks, base: str, batch_id: int) -> None:
    """Writes each sink under ``base/<sink>/batch_id=N``.

    A batch that is run again replaces its own folder, so a retry after a lost
    executor or driver leaves no duplicates.
    """
    for field in fields(sinks):
        rows = getattr(sinks, field.name)
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{base}/{field.name}/batch_id={batch_id}")
