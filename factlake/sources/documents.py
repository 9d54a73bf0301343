"""Uploaded documents: type routing and text assembly from decoded fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.grouping import MAX_ROWS, joined_lines, ordered_texts

# fixed values
SUPPORTED = {".pdf": "application/pdf",
             ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
             ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
NO_TEXT = "No text could be extracted from this file."


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes of the files under a folder; the bytes are read only where selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("filename", F.substring_index("path", "/", -1))


def _kind(ext: Column) -> Column:
    kind = F.lit(None).cast("string")
    for suffix, mime in SUPPORTED.items():
        kind = F.when(ext == suffix, mime).otherwise(kind)
    return kind


def route_files(files: DataFrame) -> DataFrame:
    """Content type of each file, or the reason it is refused."""
    ext = X.extension(F.col("filename"))
    kind = _kind(ext)
    return files.withColumns({
        "extension": ext,
        "content_type": kind,
        "error": F.when(kind.isNull(), F.concat(
            F.lit("Unsupported file type: '"), ext, F.lit("'. Supported types: .pdf, .xlsx, .docx"))),
    })


def assemble_text(fragments: DataFrame, slice_rows: int = MAX_ROWS) -> DataFrame:
    """Text of each document from its fragments.

    ``fragments`` has ``doc_id, filename, part_no, part_name, row_no, col_no, text``.
    Pages and paragraphs are joined by blank lines, sheets become lines of
    cells under a line with their name. ``part`` is always 0: a document is one
    row however long it is.
    """
    ext = X.extension(F.col("filename"))
    body = X.strip(F.col("text"))
    flat = fragments.filter(
        (ext.eqNullSafe(".pdf") & (F.coalesce("text", F.lit("")) != ""))
        | (ext.eqNullSafe(".docx") & (F.coalesce(body, F.lit("")) != ""))
    ).select("doc_id", "filename", "part_no", F.coalesce("row_no", F.lit(0)).alias("row_no"), body.alias("line"))
    sheets = fragments.filter(ext == ".xlsx")
    titles = sheets.groupBy("doc_id", "filename", "part_no").agg(
        F.concat(F.lit("Sheet: "), F.first("part_name", ignorenulls=True)).alias("line")
    ).select("doc_id", "filename", "part_no", F.lit(-1).cast("int").alias("row_no"), "line")
    rows = sheets.filter(F.col("text").isNotNull()).groupBy("doc_id", "filename", "part_no", "row_no").agg(
        joined_lines("text", "col_no", " | ", "line")
    )
    lines = flat.unionByName(titles).unionByName(rows)
    sheet = "lower(filename) LIKE '%.xlsx'"
    return ordered_texts(
        lines, ["doc_id", "filename"],
        [("part_slice", F.col("part_no"), True), ("row_slice", F.floor(F.col("row_no") / slice_rows), True)], "part_no, row_no",
        {"sheet_text": (f"CASE WHEN {sheet} THEN line END", "\\n"), "flat_text": (f"CASE WHEN NOT {sheet} THEN line END", "\\n\\n")},
    ).select("doc_id", "filename", F.lit(0).cast("bigint").alias("part"), F.coalesce("sheet_text", "flat_text", F.lit("")).alias("raw_content"))


def document_sources(fragments: DataFrame) -> DataFrame:
    """Sources of documents, or the reason a document is refused."""
    files = fragments.select("doc_id", "filename").distinct()
    routed = route_files(files).select("doc_id", "filename", "error")
    texts = assemble_text(fragments)
    joined = routed.join(texts, ["doc_id", "filename"], "left")
    blank = F.coalesce(X.strip(F.col("raw_content")), F.lit("")) == ""
    refused = F.coalesce(F.col("error"), F.when(blank, NO_TEXT))
    return joined.select(
        "doc_id", "filename", F.coalesce("part", F.lit(0)).cast("bigint").alias("part"),
        refused.alias("error"),
        F.when(refused.isNull(), F.lit("document")).alias("source_type"),
        F.when(refused.isNull(), F.col("raw_content")).alias("raw_content"),
        F.when(refused.isNull(), F.length("raw_content")).cast("bigint").alias("characters_extracted"),
    )
