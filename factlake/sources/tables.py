"""CSV files, CRM records and single facts as sources with entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import csv_lines

# fixed values
# Names that stay free for the headers of a file: any but these.
FILE, ROW_NO = "__file__", "__row_no__"
NAME_COLUMNS = ["name", "Name", "company", "Company"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows as text after ``FILE`` and ``ROW_NO``, counted from 1 in each file.

    Files are split; line breaks in quotes may lie anywhere. Columns come in the
    order in which the files, by name, first have them.
    """
    rows = csv_lines.read_rows(spark, path)
    headers = rows.filter("row_no = 0").select("file", F.col("cells").alias("header"))
    found = headers.select("file", F.posexplode("header").alias("at", "name")).groupBy("name").agg(
        F.min(F.struct("file", "at")).alias("first")).orderBy("first").collect()
    last = {r.name: F.size("header") - F.array_position(F.reverse("header"), r.name) for r in found}
    cell = [F.when(F.array_contains("header", name), F.get("cells", at)).alias(name) for name, at in last.items()]
    placed = rows.filter("row_no > 0").join(headers, "file")
    return placed.select(F.col("file").alias(FILE), F.col("row_no").alias(ROW_NO), *cell)


def csv_facts(rows: DataFrame, org_id: str, entity_type: str) -> DataFrame:
    """One fact per CSV row: filled cells in header order, and a name."""
    cells = [c for c in rows.columns if c not in (FILE, ROW_NO)]
    filled = [F.when(F.col(f"`{c}`") != "", F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in cells]
    name = reduce(
        lambda rest, c: X.or_else(F.col(f"`{c}`"), rest),
        [c for c in reversed(NAME_COLUMNS) if c in cells],
        F.concat(F.lit("Row "), F.col(ROW_NO).cast("string")),
    )
    return rows.select(
        F.col(FILE).alias("file"), F.col(ROW_NO).alias("row_no"), F.lit(org_id).alias("org_id"), F.lit(entity_type).alias("entity_type"),
        name.alias("name"), F.concat_ws(", ", *filled).alias("content"),
        F.lit("csv_import").alias("source_type"), F.lit("csv_import").alias("approved_by"),
    )


def _crm(records: DataFrame, name: Column, content: Column, entity_type: str, source_type: str) -> DataFrame:
    return records.select(
        "id", "org_id", F.lit(entity_type).alias("entity_type"), name.alias("name"), content.alias("content"),
        F.lit(source_type).alias("source_type"), F.lit("nango_import").alias("approved_by"),
    )


def _text(col: str, default: str = "") -> Column:
    return F.coalesce(F.col(col), F.lit(default))


def crm_contacts(records: DataFrame) -> DataFrame:
    name = X.strip(F.concat(_text("firstName"), F.lit(" "), _text("lastName")))
    content = F.concat(F.lit("Name: "), name, F.lit(". Email: "), _text("email"), F.lit(". Company: "), _text("company"), F.lit("."))
    return _crm(records, name, content, "Person", "hubspot_contact")


def crm_deals(records: DataFrame) -> DataFrame:
    name = _text("dealname", "Unnamed deal")
    content = F.concat(F.lit("Deal: "), name, F.lit(". Stage: "), _text("dealstage"), F.lit(". Amount: "), _text("amount"), F.lit("."))
    return _crm(records, name, content, "Project", "hubspot_deal")


def crm_summary(contacts: DataFrame, deals: DataFrame) -> DataFrame:
    both = contacts.select("org_id", F.lit("contact").alias("kind")).unionByName(
        deals.select("org_id", F.lit("deal").alias("kind")))
    return both.groupBy("org_id").agg(
        F.count_if(F.col("kind") == "contact").alias("contacts"), F.count_if(F.col("kind") == "deal").alias("deals")
    )


def source_rows(facts: DataFrame, *keys: str) -> DataFrame:
    """Source side of imported facts."""
    return facts.select(*keys, "org_id", "source_type", F.col("content").alias("raw_content"))


def entity_rows(facts: DataFrame, *keys: str) -> DataFrame:
    """Entity side of imported facts, linked to the source by the same keys."""
    return facts.select(*keys, "org_id", "entity_type", "name", "content", "approved_by", F.lit("active").alias("status"))


def manual_facts(inputs: DataFrame) -> DataFrame:
    """Facts typed in by hand: stored as source and approved entity without review."""
    return inputs.select(
        "id", "org_id", "source_type", F.col("raw_content").alias("content"), "entity_type",
        F.col("entity_name").alias("name"), "approved_by", "permalink",
    )


def promote_sources(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """Entities from whole sources; ``requests`` has ``source_id, org_id, approved_by``."""
    asked = requests.select(F.col("source_id").alias("id"), F.col("org_id").alias("to_org"), "approved_by")
    return sources.select("id", "raw_content").join(asked, "id").select(
        F.col("to_org").alias("org_id"), F.lit("Decision").alias("entity_type"),
        F.lit("Promoted from history").alias("name"), F.col("raw_content").alias("content"),
        F.col("id").alias("source_id"), "approved_by", F.lit("active").alias("status"),
    )
