"""One-hop property graph: nodes and edges as tables joined by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .access import access_class, visible_to, with_access_classes, with_source
from .grouping import first_k

# fixed values
EDGE_LIMIT = 30
NEIGHBOUR_LIMIT = 20
EDGE_ORDER = ["from_id", "to_id", "relationship_type"]


def upsert_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds new ids; a known id takes the new content only.

    ``changes`` carries ``seq``; where it repeats an id the first row creates
    the node and the last one sets the content.
    """
    latest = changes.groupBy("entity_id").agg(
        F.min_by(F.struct("org_id", "entity_type", F.coalesce("name", F.lit("")).alias("name")), "seq").alias("made"),
        F.max_by("content", "seq").alias("new_content"),
    )
    old = nodes.select("entity_id", F.struct("org_id", "entity_type", "name").alias("old"), "content")
    return old.join(latest, "entity_id", "full_outer").withColumn("kept", F.coalesce("old", "made")).select(
        "entity_id", "kept.*", F.coalesce("new_content", "content").alias("content")
    )


def append_edges(edges: DataFrame, changes: DataFrame, nodes: DataFrame, distinct: bool = False) -> DataFrame:
    """Adds edges whose two ends exist. Equal edges stay side by side unless ``distinct``."""
    ids = nodes.select("entity_id")
    sound = (
        changes.join(ids.withColumnRenamed("entity_id", "from_id"), "from_id", "left_semi")
        .join(ids.withColumnRenamed("entity_id", "to_id"), "to_id", "left_semi")
    )
    both = edges.unionByName(sound.select(*edges.columns))
    return both.distinct() if distinct else both


def _with_from(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    side = nodes.select(F.col("entity_id").alias("from_id"), "org_id",
                        F.col("entity_type").alias("from_type"), F.col("name").alias("from_name"))
    return edges.join(side, "from_id")


def _with_to(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    side = nodes.select(F.col("entity_id").alias("to_id"), F.col("entity_type").alias("to_type"),
                        F.col("name").alias("to_name"), F.col("content").alias("to_content"))
    return edges.join(side, "to_id")


def _shown(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select(
        "org_id", *more, "from_type", "from_name", F.col("relationship_type").alias("relationship"),
        "to_type", "to_name", "to_content",
    )


def match_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every edge with both of its nodes; the organisation is that of its start."""
    return _shown(_with_to(_with_from(edges, nodes), nodes))


def list_edges(edges: DataFrame, nodes: DataFrame, limit: int = EDGE_LIMIT) -> DataFrame:
    """First ``limit`` edges per organisation.

    Both ends of a stored edge exist (``append_edges``), so the limit is taken
    before the second join, which then meets ``limit`` rows per organisation.
    """
    kept = first_k(_with_from(edges, nodes), ["org_id"], [F.col(c) for c in EDGE_ORDER], limit)
    return _shown(_with_to(kept, nodes), "rank")


def list_edges_visible(
    edges: DataFrame, nodes: DataFrame, facts: DataFrame, sources: DataFrame, memberships: DataFrame,
    org_id: str, user_id: str, limit: int = EDGE_LIMIT, check_both_ends: bool = False,
) -> DataFrame:
    """``list_edges`` of one organisation over edges whose start the user may see.

    Visibility is checked before the limit, so hidden edges do not use it up.
    """
    placed = with_source(facts.filter(F.col("org_id") == org_id).select("id", "org_id", "source_id"),
                         sources, "channel_id", "channel_is_private")
    seen = visible_to(placed, memberships, org_id, user_id).select("id")
    own = _with_from(edges, nodes.filter(F.col("org_id") == org_id))
    kept = own.join(seen.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    if check_both_ends:
        kept = kept.join(seen.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    kept = first_k(kept, ["org_id"], [F.col(c) for c in EDGE_ORDER], limit)
    return _shown(_with_to(kept, nodes), "rank")


def list_edges_for(
    questions: DataFrame, edges: DataFrame, nodes: DataFrame, facts: DataFrame, sources: DataFrame, memberships: DataFrame,
    limit: int = EDGE_LIMIT,
) -> DataFrame:
    """First ``limit`` edges for each question (``query_id, org_id, user_id``) whose start its user may see.

    Edges are limited per audience first: what one user sees first lies in the
    first of each of their audiences. They are then ranked once per user, and a question
    takes the list of its user, so that no task sorts what all questions see. Only
    questions that share an id are ranked together again.
    """
    placed = with_source(facts.select(F.col("id").alias("from_id"), "source_id"), sources, "channel_id", "channel_is_private")
    classed = _with_from(edges, nodes).join(placed.select("from_id", access_class().alias("access_class")), "from_id")
    order = [F.col(c) for c in EDGE_ORDER]
    kept = first_k(classed, ["org_id", "access_class"], order, limit).drop("rank")
    users = with_access_classes(questions.select("org_id", "user_id").distinct(), memberships)
    lists = first_k(kept.join(users, ["org_id", "access_class"]), ["org_id", "user_id"], order, limit).drop("access_class")
    asked = questions.select("query_id", F.col("org_id").alias("q_org"), F.col("user_id").alias("q_user"),
                             F.count("*").over(Window.partitionBy("query_id")).alias("times"))

    def taken(some: DataFrame, of: DataFrame) -> DataFrame:
        return some.join(of, (some["q_org"] == of["org_id"]) & some["q_user"].eqNullSafe(of["user_id"]))

    alone = taken(asked.filter("times = 1"), _with_to(lists, nodes))
    shared = first_k(taken(asked.filter("times > 1"), lists).drop("rank"), ["query_id"], order, limit)
    return _shown(alone, "query_id", "rank").unionByName(_shown(_with_to(shared, nodes), "query_id", "rank"))


def neighbourhood(edges: DataFrame, nodes: DataFrame, org_id: str, name: str, limit: int = NEIGHBOUR_LIMIT) -> DataFrame:
    """First ``limit`` edges of an organisation that touch a node whose name contains ``name``."""
    starts = nodes.filter(F.col("org_id") == org_id).select(
        F.col("entity_id").alias("from_id"), "org_id", F.col("entity_type").alias("from_type"), F.col("name").alias("from_name"))
    named = nodes.filter(F.col("name").contains(name)).select(
        F.col("entity_id").alias("to_id"), F.lit(True).alias("hit"))
    touched = (
        edges.join(starts, "from_id").join(named, "to_id", "left")
        .filter(F.col("from_name").contains(name) | F.col("hit"))
        .orderBy(*EDGE_ORDER).limit(limit).drop("hit")
    )
    return _shown(_with_to(touched, nodes))


