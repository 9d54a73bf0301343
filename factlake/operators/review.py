"""Review queue: approve and reject, single or whole organisations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import last_change

NOT_FOUND = "Pending entity not found."


def _entities(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("id").alias("pending_id"), "org_id", "entity_type", "name", "content", "source_id", "approved_by",
        F.lit("active").alias("status"),
    )


def approve(pending: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New entities, the remaining queue, and requests that met no item (``id, approved_by``)."""
    asked = last_change(requests, "id")
    return _entities(pending.join(asked, "id")), _remaining(pending, asked, "id"), not_found(pending, asked)


def reject(pending: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The remaining queue, and requests that met no item."""
    return _remaining(pending, requests, "id"), not_found(pending, requests)


def _remaining(pending: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    return pending.join(requests.select(key), key, "left_anti")


def not_found(pending: DataFrame, requests: DataFrame) -> DataFrame:
    return requests.select("id").distinct().join(pending.select("id"), "id", "left_anti").withColumn(
        "error", F.lit(NOT_FOUND))


def bulk_approve(pending: DataFrame, orgs: DataFrame, approved_by: str = "bulk") -> tuple[DataFrame, DataFrame, DataFrame]:
    """New entities, the remaining queue and a message per organisation."""
    chosen = pending.join(orgs.select("org_id"), "org_id", "left_semi")
    entities = _entities(chosen.withColumn("approved_by", F.lit(approved_by)))
    return entities, _remaining(pending, orgs, "org_id"), _counted(pending, orgs, "items approved and saved to memory.")


def bulk_reject(pending: DataFrame, orgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _remaining(pending, orgs, "org_id"), _counted(pending, orgs, "items rejected and removed from queue.")


def _counted(pending: DataFrame, orgs: DataFrame, text: str) -> DataFrame:
    counts = pending.groupBy("org_id").agg(F.count("*").alias("items"))
    return orgs.select("org_id").distinct().join(counts, "org_id", "left").select(
        "org_id", F.coalesce("items", F.lit(0)).alias("items"),
        F.concat(F.coalesce("items", F.lit(0)).cast("string"), F.lit(f" {text}")).alias("message"),
    )
