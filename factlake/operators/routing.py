"""Score routing, queue cap, first-wins storing and edge endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouping import first_k, fresh_keys

# fixed values
LIVE_THRESHOLD = 0.7
BACKFILL_THRESHOLD = 0.8
REVIEW_THRESHOLD = 0.5
QUEUE_CAP = 20
PAUSED = "Pipeline paused: approval queue has reached 20 pending items. Review and clear the queue to resume."
IDENTITY = ["org_id", "entity_type", "name"]


def route(candidates: DataFrame, threshold: float = LIVE_THRESHOLD) -> DataFrame:
    score = F.col("confidence_score")
    return candidates.withColumn(
        "route",
        F.when(F.col("approved") & (score >= threshold), "approved")
        .when(score >= REVIEW_THRESHOLD, "pending").otherwise("rejected"),
    )


def pending_per_source(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("route") == "pending").groupBy("org_id", "source_id").agg(F.count("*").alias("pending"))


def queue_cutoffs(pending: DataFrame, queue: DataFrame, cap: int = QUEUE_CAP) -> DataFrame:
    """Last source each organisation stores before its review queue is full.

    ``pending`` has rows per organisation and source, ``queue`` the items
    already waiting (``org_id, waiting``). At most ``cap`` sources with pending
    items fill a queue, so only the first ``cap`` of each organisation are
    looked at, whatever its size. Organisations whose queue stays open have no
    row; ``last_source`` is null where nothing is stored at all.
    """
    first = first_k(pending.filter("pending > 0"), ["org_id"], [F.col("source_id")], cap)
    so_far = F.sum("pending").over(
        Window.partitionBy("org_id").orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0)
    )
    filled = (
        first.withColumn("so_far", so_far).join(queue, "org_id", "left")
        .filter(F.coalesce("waiting", F.lit(0)) + F.col("so_far") >= cap)
        .groupBy("org_id").agg(F.min("source_id").alias("last_source"))
    )
    full = queue.filter(F.col("waiting") >= cap).select("org_id", F.lit(None).cast("bigint").alias("last_source"))
    return filled.join(full, "org_id", "left_anti").unionByName(full)


def admit(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Flags rows whose source came before the queue was full; later sources wait whole."""
    marked = fresh_keys(cutoffs.select("org_id", "last_source", F.lit(True).alias("fills")), "org_id")
    keep = F.col("fills").isNull() | F.coalesce(F.col("source_id") <= F.col("last_source"), F.lit(False))
    return rows.join(marked, "org_id", "left").withColumn("admitted", keep).drop("last_source", "fills")


def pause_logs(flagged: DataFrame) -> DataFrame:
    """One log row per source that met a full queue."""
    return flagged.filter(~F.col("admitted")).select("org_id", "source_id").distinct().select(
        "org_id", "source_id", F.lit("pipeline_paused").alias("log_type"), F.lit(PAUSED).alias("content")
    )


def _named(name: str = "name") -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def active_names(entities: DataFrame) -> DataFrame:
    """Stored identity of each active named entity, the lowest id where there are several."""
    return entities.filter((F.col("status") == "active") & _named()).groupBy(*IDENTITY).agg(
        F.min("id").alias("entity_id")
    )


def arrival(rows: DataFrame) -> list[Column]:
    """Order of candidates: their place in their source where they have one, else ``seq``."""
    return [F.col("source_id"), F.col("pos")] if "pos" in rows.columns else [F.col("seq")]


def first_of_name(approved: DataFrame) -> DataFrame:
    """First candidate of each identity in arrival order; nameless ones are all kept.

    Nameless rows skip the window, so they cannot pile up in one task, and map
    tasks keep one row per identity before the shuffle.
    """
    return _first_named(approved).unionByName(approved.filter(~_named()))


def _first_named(approved: DataFrame) -> DataFrame:
    return first_k(approved.filter(_named()), IDENTITY, arrival(approved), 1).drop("rank")


def _unknown(named: DataFrame, entities: DataFrame) -> DataFrame:
    known = fresh_keys(active_names(entities).select(*IDENTITY), "name")
    return named.join(known, IDENTITY, "left_anti")


def not_stored_yet(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates whose identity no active entity has; nameless ones always pass."""
    return _unknown(candidates.filter(_named()), entities).unionByName(candidates.filter(~_named()))


def new_entities(approved: DataFrame, entities: DataFrame) -> DataFrame:
    """Approved candidates that are stored: first of their name and not stored before."""
    return _unknown(_first_named(approved), entities).unionByName(approved.filter(~_named()))


def resolve_edges(
    edges: DataFrame, approved: DataFrame, stored: DataFrame, entities: DataFrame
) -> DataFrame:
    """Edges between ids. ``edges`` names its endpoints within one source.

    A name stands for the last approved candidate of the source that has it;
    a candidate not stored itself stands for the entity of its identity.
    ``stored`` has the id given to each new candidate (``seq, id``).
    """
    fresh = stored.filter(_named()).select(*IDENTITY, F.col("id").alias("entity_id"))
    known = active_names(entities).unionByName(fresh).groupBy(*IDENTITY).agg(F.min("entity_id").alias("entity_id"))
    known = fresh_keys(known, "name")
    # The last candidate of a name in a source is chosen before its identity is looked up.
    last = (
        approved.filter(_named()).groupBy("source_id", "name")
        .agg(F.max_by(F.struct("org_id", "entity_type"), F.struct(*arrival(approved))).alias("last"))
        .select("source_id", "name", "last.*")
    )
    ids = last.join(known, IDENTITY).select("source_id", "org_id", "name", "entity_id")

    def end(side: str) -> DataFrame:
        cols = [F.col("source_id"), F.col("name").alias(f"{side}_name"), F.col("entity_id").alias(f"{side}_id")]
        return ids.select(*cols, *([F.col("org_id")] if side == "from" else []))

    return edges.join(end("from"), ["source_id", "from_name"]).join(end("to"), ["source_id", "to_name"]).select(
        "org_id", "source_id", "from_id", "to_id",
        F.coalesce("relationship_type", F.lit("related_to")).alias("relationship_type"),
    )


def rejection_logs(rejected: DataFrame, with_reason: bool = True) -> DataFrame:
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("None"))

    parts = [F.lit("REJECTED: "), shown("name"), F.lit(" — "), shown("content")]
    if with_reason:
        parts += [F.lit(" — Reason: "), shown("critic_reason")]
    return rejected.select("org_id", "source_id", "seq", F.lit("rejected_entity").alias("log_type"),
                           F.concat(*parts).alias("content"))


def run_counters(routed: DataFrame, *keys: str) -> DataFrame:
    """Candidates proposed, approved, rejected and pending per source or organisation."""
    return routed.groupBy(*keys).agg(
        F.count("*").alias("proposed"),
        *[F.count_if(F.col("route") == r).alias(r) for r in ("approved", "rejected", "pending")],
    )
