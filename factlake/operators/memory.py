"""Listings of facts, queues and logs, and snapshot mutations of the fact table.

A mutation is a function from the old table and a change table to the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .grouping import first_k

# fixed values
PAGE = 20
LOG_LIMIT = 20
NO_BRIEFING = "No briefing yet."
NOT_FOUND = "One or both entity IDs not found."


def newest() -> list[Column]:
    return [F.desc("created_at"), F.asc("id")]


# --- listings ----------------------------------------------------------------

def active_facts(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("superseded_at").isNull())


def by_status(facts: DataFrame, status: str = "active") -> DataFrame:
    return facts.filter(F.col("status") == status)


def of_type(facts: DataFrame, entity_type: str) -> DataFrame:
    """Active facts of one type, such as Belief or Decision."""
    return active_facts(facts).filter(F.col("entity_type") == entity_type)


def page(facts: DataFrame, org_id: str, entity_type: str | None = None, limit: int = PAGE, offset: int = 0) -> DataFrame:
    rows = active_facts(facts).filter(F.col("org_id") == org_id)
    if entity_type:
        rows = rows.filter(F.col("entity_type") == entity_type)
    return rows.orderBy(*newest()).offset(offset).limit(limit)


def page_total(facts: DataFrame, org_id: str, entity_type: str | None = None) -> DataFrame:
    rows = active_facts(facts).filter(F.col("org_id") == org_id)
    if entity_type:
        rows = rows.filter(F.col("entity_type") == entity_type)
    return rows.agg(F.count("*").alias("total"))


def review_queue(pending: DataFrame, org_id: str, review_type: str | None = None) -> DataFrame:
    rows = pending.filter(F.col("org_id") == org_id)
    if review_type:
        rows = rows.filter(F.col("review_type") == review_type)
    return rows.orderBy(*newest())


def latest_logs(logs: DataFrame, log_type: str, limit: int = LOG_LIMIT) -> DataFrame:
    """Newest ``limit`` logs of a type per organisation."""
    return first_k(logs.filter(F.col("log_type") == log_type), ["org_id"], newest(), limit)


def latest_briefings(orgs: DataFrame, logs: DataFrame) -> DataFrame:
    """Newest briefing of each organisation, or the notice that there is none."""
    last = logs.filter(F.col("log_type") == "daily_briefing").groupBy("org_id").agg(
        F.max_by(F.struct("content", "created_at"), F.struct("created_at", -F.col("id"))).alias("last"))
    return orgs.select("org_id").join(last, "org_id", "left").select(
        "org_id", F.col("last.content").alias("briefing"), F.col("last.created_at").alias("created_at"),
        F.when(F.col("last").isNull(), NO_BRIEFING).alias("message"),
    )


def has_memory(facts: DataFrame) -> DataFrame:
    """Organisation and type pairs with an active fact."""
    counts = active_facts(facts).groupBy("org_id", "entity_type").agg(F.count("*").alias("facts"))
    return counts.select("org_id", "entity_type", (F.col("facts") > 0).alias("has_memory"))


def since(rows: DataFrame, ts_col: str, now: Column, hours: float) -> DataFrame:
    return rows.filter(F.col(ts_col) >= now - F.make_dt_interval(secs=F.lit(hours * 3600)))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last state of each key; ``order`` has the newest first."""
    return first_k(rows, keys, order, 1).drop("rank")


# --- mutations ---------------------------------------------------------------

def supersede(facts: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """New fact table and one outcome per change (``seq, org_id, old_id, new_id``).

    Changes apply in ``seq`` order: the last one that touches a fact sets its
    status, the last one that retires it sets when and by which.
    """
    ids = facts.select(F.col("org_id").alias("f_org"), F.col("id").alias("f_id"))

    def known(side: str) -> DataFrame:
        return ids.select(F.col("f_org").alias("org_id"), F.col("f_id").alias(side))

    good = changes.join(known("old_id"), ["org_id", "old_id"], "left_semi").join(
        known("new_id"), ["org_id", "new_id"], "left_semi")

    def touch(fact: str, step: Column, to: str, by: Column) -> Column:
        return F.struct(F.col("org_id").alias("t_org"), F.col(fact).alias("t_id"), step.alias("step"), F.lit(to).alias("to"), by.alias("by_id"))

    step = F.col("seq") * 2
    touches = good.select(F.explode(F.array(
        touch("old_id", step, "superseded", F.col("new_id")),
        touch("new_id", step + 1, "active", F.lit(None).cast("bigint")),
    )).alias("t")).select("t.*")
    latest = touches.groupBy("t_org", "t_id").agg(
        F.max_by("to", "step").alias("to"),
        F.max_by("by_id", F.when(F.col("to") == "superseded", F.col("step"))).alias("by_id"),
        F.bool_or(F.col("to") == "superseded").alias("retired"),
    )
    old_by = F.col("superseded_by_id") if "superseded_by_id" in facts.columns else F.lit(None).cast("bigint")
    retired = F.coalesce("retired", F.lit(False))
    table = facts.join(latest, (facts["org_id"] == latest["t_org"]) & (facts["id"] == latest["t_id"]), "left").withColumns({
        "status": F.coalesce("to", "status"),
        "superseded_at": F.when(retired, now).otherwise(F.col("superseded_at")),
        "superseded_by_id": F.when(retired, F.col("by_id")).otherwise(old_by),
    }).drop("t_org", "t_id", "to", "by_id", "retired")
    flags = good.select("seq", F.lit(True).alias("found"))
    outcome = changes.join(flags, "seq", "left").select(
        "seq", "org_id", "old_id", "new_id",
        F.when(F.col("found"), F.concat(F.lit("Entity "), F.col("old_id").cast("string"), F.lit(" superseded by "),
                                        F.col("new_id").cast("string"), F.lit("."))).alias("message"),
        F.when(F.col("found").isNull(), NOT_FOUND).alias("error"),
    )
    return table, outcome


def mark_processed(sources: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Sets ``processed_at`` of the sources listed in ``done`` (``id``, and ``org_id`` where organisations may share ids)."""
    on = [c for c in ("org_id", "id") if c in done.columns]
    flag = done.select(*on).distinct().withColumn("done_", F.lit(True))
    return sources.join(flag, on, "left").withColumn(
        "processed_at", F.when(F.col("done_"), now).otherwise(F.col("processed_at"))).select(*sources.columns)


def last_change(changes: DataFrame, key: str) -> DataFrame:
    """One change per key: the last by ``seq``, or without one the greatest row, so that reruns agree."""
    order = F.col("seq") if "seq" in changes.columns else F.struct(*changes.columns)
    return changes.groupBy(F.col(key).alias("key_")).agg(F.max_by(F.struct(*changes.columns), order).alias("last_")).select("last_.*")


def set_briefing_focus(profiles: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New profile table and the changes whose organisation is unknown; one change per organisation."""
    new = last_change(changes, "org_id").select("org_id", X.strip(F.col("briefing_focus")).alias("new_focus"))
    table = profiles.join(new, "org_id", "left").withColumn(
        "briefing_focus", F.coalesce("new_focus", "briefing_focus")).drop("new_focus")
    unknown = changes.join(profiles.select("org_id"), "org_id", "left_anti").select(
        "org_id", F.lit("Organisation not found.").alias("error"))
    return table, unknown


def unique_inserts(rows: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Flags each new row: rejected where its key is stored or came earlier in the batch.

    ``order`` is the unique id of the rows and their arrival order.
    """
    # One winner per key is found by aggregation; the rows then meet it by their own id.
    winners = rows.groupBy(key).agg(F.min(order).alias(order)).join(existing.select(key), key, "left_anti")
    return rows.join(winners.select(order, F.lit(True).alias("won_")), order, "left").withColumn(
        "accepted", F.coalesce("won_", F.lit(False))).drop("won_")


def create_orgs(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """New organisations by business name; a taken name is refused."""
    return unique_inserts(requests, profiles, "business_name", "id").withColumn(
        "message", F.when(F.col("accepted"), "Organisation created successfully").otherwise("Organisation already exists"))
