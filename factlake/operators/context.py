"""Ordered text built from facts: snapshots, fact blocks, notes, answer contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .grouping import MAX_ROWS, fresh_keys, id_slice, joined_lines, ordered_texts

# fixed values
NO_PROFILE = "No business profile found for this organisation."
NO_FACTS = "No entities on record yet."
NO_HITS = "No relevant facts found in memory."
NO_EDGES = "No relationship data found."


def fact_line() -> Column:
    return F.concat(F.lit("["), "entity_type", F.lit("] "), F.coalesce("name", F.lit("")), F.lit(": "), "content")


def edge_line() -> Column:
    return F.concat(
        F.lit("["), "from_type", F.lit("] "), "from_name", F.lit(" —"), "relationship", F.lit("→ ["), "to_type",
        F.lit("] "), "to_name", F.lit(": "), "to_content",
    )


def profile_header() -> Column:
    """Profile lines; a missing value prints as None."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    return F.concat(
        F.lit("Business: "), shown("business_name"), F.lit("\nIndustry: "), shown("industry"),
        F.lit("\nCore services: "), shown("core_services"), F.lit("\nWhat they don't do: "), shown("what_they_dont_do"),
        F.lit("\nTeam size: "), shown("team_size"),
    )


def active(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("superseded_at").isNull())


def snapshots(orgs: DataFrame, profiles: DataFrame, facts: DataFrame) -> DataFrame:
    """Context text of each organisation in ``orgs``: profile, then facts by type, newest first.

    ``part`` is always 0: a snapshot is one row however many facts it has.
    """
    hour = ("hour_slice", F.date_trunc("hour", F.col("created_at").cast("timestamp")), False)
    lines = active(facts).select("org_id", "entity_type", "created_at", "id", fact_line().alias("line"))
    blocks = ordered_texts(lines, ["org_id"], [("type_slice", F.col("entity_type"), True), hour],
                           "entity_type, created_at DESC, id", {"facts": ("line", "\\n")})
    heads = profiles.select("org_id", profile_header().alias("header"))
    text = F.when(F.col("header").isNull(), NO_PROFILE).otherwise(
        F.concat("header", F.lit("\n\n== Known facts ==\n"), F.coalesce("facts", F.lit(NO_FACTS))))
    rows = orgs.select("org_id").join(heads, "org_id", "left").join(blocks, "org_id", "left")
    return rows.select("org_id", F.lit(0).cast("bigint").alias("part"), text.alias("context"))


def belief_blocks(facts: DataFrame, slice_width: int = MAX_ROWS) -> DataFrame:
    """Active beliefs of each organisation as lines, one row per organisation (``part`` is 0)."""
    beliefs = active(facts).filter(F.col("entity_type") == "Belief").select(
        "org_id", "id", F.concat(F.lit("- "), "content").alias("line"))
    return ordered_texts(beliefs, ["org_id"], [id_slice("id", slice_width)], "id", {"beliefs": ("line", "\\n")}).withColumn(
        "part", F.lit(0).cast("bigint"))


def hits_with_facts(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """Search hits with the text of the fact found. Only ids travelled through the search."""
    return hits.join(facts.select("id", "entity_type", "name", "content", "source_id"), "id")


def fact_blocks(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Fact lines of each query in distance order; ``hits`` carry the fact columns."""
    blocks = hits.withColumn("line", fact_line()).groupBy("query_id").agg(joined_lines("line", "rank", name="fact_block"))
    return queries.join(blocks, "query_id", "left").withColumn("fact_block", F.coalesce("fact_block", F.lit(NO_HITS)))


def citations(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per hit that has a source."""
    side = sources.select(F.col("id").alias("src_id"), "permalink", "source_type")
    cited = hits.filter(F.col("source_id").isNotNull())
    return cited.join(side, cited["source_id"] == side["src_id"], "left").select(
        "query_id", "rank", "source_id", "entity_type", "name", "permalink", "source_type"
    )


def relationship_blocks(edges: DataFrame, key: str = "org_id") -> DataFrame:
    """Edge lines per organisation, or per ``key``; ``edges`` is the limited edge list with its ``rank``."""
    return edges.withColumn("line", edge_line()).groupBy(key).agg(joined_lines("line", "rank", name="edge_block"))


def answer_contexts(
    questions: DataFrame, fact_block: DataFrame, edge_block: DataFrame, profiles: DataFrame
) -> DataFrame:
    """Profile and memory section of each question.

    The relationship part appears only for questions that ask for it;
    ``edge_block`` is by ``query_id`` (what its user may see) or by ``org_id``.
    """
    by = "query_id" if "query_id" in edge_block.columns else "org_id"
    if by == "org_id":
        edge_block = fresh_keys(edge_block, by)
    heads = profiles.select("org_id", F.concat(profile_header(), F.lit("\n")).alias("profile"))
    graph = F.when(X.asks_for_relationships(F.col("question")), F.concat(
        F.lit("\n\n== Entity Relationships ==\n"), F.coalesce("edge_block", F.lit(NO_EDGES)))).otherwise("")
    return (
        questions.join(fact_block.select("query_id", "fact_block"), "query_id")
        .join(edge_block, by, "left").join(heads, "org_id", "left")
        .select(
            "query_id", "org_id", "question", F.coalesce("profile", F.lit("")).alias("profile"),
            F.concat(F.lit("== Verified Facts ==\n"), "fact_block", graph).alias("memory"),
        )
    )


def contradiction_notes(new_facts: DataFrame, hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Review items for stored facts that contradict what they resemble.

    ``hits`` are the neighbours of each new fact with the fact columns;
    ``verdicts`` has ``id, contradiction, reason``.
    """
    near = hits.groupBy(F.col("query_id").alias("id")).agg(
        F.to_json(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "entity_type", "name", "content"))),
            lambda h: F.struct(h["entity_type"].alias("entity_type"), F.coalesce(h["name"], F.lit("")).alias("name"),
                               h["content"].alias("content")),
        )).alias("neighbours")
    )
    clashing = verdicts.filter("contradiction").select("id", "reason")
    return new_facts.join(clashing, "id").join(near, "id").select(
        "id", "org_id", "source_id", "entity_type", "name",
        F.concat(F.lit("NEW: "), "content", F.lit("\n\nCONFLICTS WITH: "), "neighbours", F.lit("\n\nREASON: "),
                 F.coalesce("reason", F.lit("None"))).alias("content"),
        F.coalesce("reason", F.lit("Contradiction detected.")).alias("critic_reason"),
        F.lit(0.5).alias("confidence_score"), F.lit("contradiction").alias("review_type"),
    )
