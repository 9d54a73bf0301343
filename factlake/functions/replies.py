"""Column functions that read model replies.

The verdict functions take a parsed reply. Parse it into a column of its own
first, so that it is parsed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, strip_fence

ENTITY = "struct<entity_type:string,name:string,content:string>"
EDGE = "struct<from_name:string,from_type:string,relationship_type:string,to_name:string,to_type:string>"

# fixed values
BAD_CRITIC = "Critic returned invalid response."
BAD_CHECK = "Could not parse response."


def parsed(reply: Column) -> Column:
    """Reply as a variant, null where it is no JSON."""
    return F.try_parse_json(strip_fence(strip(reply)))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_list(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def member(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def list_member(value: Column, path: str, element: str) -> Column:
    """A list member, empty where it is absent or of another type."""
    return F.coalesce(member(value, path, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def truthy(value: Column, path: str) -> Column:
    """A flag member read the way a dynamic language tests it; null where the key is absent."""
    item = member(value, path, "variant")
    kind = F.schema_of_variant(item)
    text = item.cast("string")
    return (
        F.when(kind == "BOOLEAN", member(value, path, "boolean"))
        .when(kind == "VOID", F.lit(False))
        .when(kind == "STRING", text != "")
        .when(kind.startswith("OBJECT"), text != "{}")
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.isNotNull(), member(value, path, "double") != 0)
    )


def critic_verdict(value: Column) -> Column:
    """``approved``, ``confidence_score`` and ``reason`` of a critic reply.

    An absent member takes its default; a reply that is no JSON object, or whose
    score is no number, becomes the invalid-response verdict.
    """
    has_score = F.schema_of_variant(member(value, "$.confidence_score", "variant")).isNotNull()
    number = member(value, "$.confidence_score", "double")
    score = F.when(has_score, number).otherwise(F.lit(0.5))
    good = is_object(value) & score.isNotNull()
    return F.struct(
        F.when(good, F.coalesce(truthy(value, "$.approved"), F.lit(False))).otherwise(False).alias("approved"),
        F.when(good, score).otherwise(0.0).alias("confidence_score"),
        F.when(good, F.coalesce(member(value, "$.reason", "string"), F.lit(""))).otherwise(BAD_CRITIC).alias("reason"),
    )


def contradiction_verdict(value: Column) -> Column:
    good = is_object(value)
    return F.struct(
        F.when(good, F.coalesce(truthy(value, "$.contradiction"), F.lit(False))).otherwise(False).alias("contradiction"),
        F.when(good, member(value, "$.reason", "string")).otherwise(BAD_CHECK).alias("reason"),
    )


def belief_verdict(value: Column) -> Column:
    return F.struct(
        F.coalesce(truthy(value, "$.conflict"), F.lit(False)).alias("conflict"),
        F.coalesce(member(value, "$.belief", "string"), F.lit("")).alias("belief"),
        F.coalesce(member(value, "$.reason", "string"), F.lit("")).alias("reason"),
    )


def judge_score(verdict: Column) -> Column:
    return F.when(F.upper(verdict).contains("PASS"), 1.0).otherwise(0.0)
