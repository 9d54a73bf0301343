r"""WARC derivatives: a metadata and a conversion record for each response.

``responses`` makes response records of a table of pages; ``derive`` turns
response records into linked derivatives. Each derivative names its response in
WARC-Refers-To with its URI and date, and keeps the response's HTTP headers and
its payload and block digests: the metadata record in its fields, the
conversion record in its headers. Blocks are whole; digests are sha256 in hex
over the UTF-8 bytes of a block.

Plain text: scripts, styles and comments go, tags that end a line become line
ends, other tags go, named entities are decoded once, white space collapses,
blank lines go.

Everything is column expressions. Defined cases: a null URL is an empty one and
its headers are left out; a null or empty page has an empty payload and text;
identical rows give identical record ids; unclosed elements run to the end of the page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"

# Elements whose content isn't text, elements that end a line, and entities (& itself last).
UNSEEN = (r"(?is)<(?:script\b[^>]*>.*?(?:</script\s*>|\z)|style\b[^>]*>.*?(?:</style\s*>|\z)"
          r"|noscript\b[^>]*>.*?(?:</noscript\s*>|\z)|!--.*?(?:-->|\z))")
LINE_ENDS = (r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option"
             r"|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>")
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&reg;": "®",
            "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&laquo;": "«", "&raquo;": "»", "&euro;": "€", "&amp;": "&"}


def without_tags(html: Column) -> Column:
    seen = F.regexp_replace(html, UNSEEN, " ")
    return F.regexp_replace(F.regexp_replace(seen, LINE_ENDS, "\n"), r"<[a-zA-Z/!?][^>]*>", "")


def readable(bare: Column) -> Column:
    """Entities decoded, white space collapsed. ``bare`` should be a column: it is read twice."""
    decoded = reduce(lambda t, e: F.replace(t, F.lit(e), F.lit(ENTITIES[e])), ENTITIES, bare)
    text = F.when(F.contains(bare, F.lit("&")), decoded).otherwise(bare)
    # Single spaces stay as they are; only longer or other white space is rewritten.
    text = F.regexp_replace(text, r"(?: ?[\t\r\x0b\x0c\x{a0}]|  )[ \t\r\x0b\x0c\x{a0}]*", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), r"^\n|\n\z", ""))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, key: str, url: str, html: str, date: str = DATE) -> DataFrame:
    """Response records: ``source_key``, ``record_id``, ``target_uri``, ``warc_date``, ``http_headers``, ``payload`` and digests."""
    payload, uri = F.coalesce(F.col(html), F.lit("")), F.coalesce(F.col(url), F.lit(""))
    rows = pages.select(F.col(key).alias("source_key"), uri.alias("target_uri"), F.lit(date).alias("warc_date"), payload.alias("payload"))
    rows = rows.withColumn("http_headers", F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length("payload").cast("string"), F.lit(CRLF)))
    return rows.withColumns({
        "payload_digest": _digest(F.col("payload")),
        "block_digest": _digest(F.concat("http_headers", F.lit(CRLF), "payload")),
    }).withColumn("record_id", _uuid(F.lit("response"), F.coalesce(F.col("source_key").cast("string"), F.lit("")), F.col("target_uri"), F.col("block_digest")))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field without a value is left out."""
    return F.concat(*[F.when(F.length(v) > 0, F.concat(F.lit(f"{name}: "), v, F.lit(CRLF))).otherwise("") for name, v in fields])


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response: ``source_key``, ``warc_type``, ``record_id``, ``refers_to``, digests, ``headers`` and ``block``."""
    page = F.col("payload")
    title = F.regexp_extract(page, r"(?is)<title\b[^>]*>([^<]*)", 1)
    # Facts are columns of their own first: a header line looks at its value twice.
    known = records.withColumns({
        "fact_title": F.trim(F.regexp_replace(title, r"\s+", " ")),
        "fact_language": F.regexp_extract(page, r'(?i)<html\b[^>]*?\blang="?([\w-]*)', 1),
        "fact_charset": F.regexp_extract(page, r'(?i)<meta\b[^>]*?\bcharset="?([\w-]*)', 1),
        "fact_outlinks": F.regexp_count(page, F.lit(r"(?i)<a\s[^>]*?\bhref=")).cast("string"),
        "fact_headers": F.trim(F.replace("http_headers", F.lit(CRLF), F.lit("; "))),
        "bare": without_tags(page),
    })
    facts = _lines(
        ("title", F.col("fact_title")), ("language", F.col("fact_language")), ("charset", F.col("fact_charset")),
        ("outlinks", F.col("fact_outlinks")), ("sourcePayloadDigest", F.col("payload_digest")),
        ("sourceBlockDigest", F.col("block_digest")), ("sourceHttpHeaders", F.col("fact_headers")),
    )
    both = known.withColumns({"facts": facts, "text": readable(F.col("bare"))}).select("*", F.explode(F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), F.col("facts").alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )).alias("made"))
    both = both.select("source_key", "made.*", "target_uri", "warc_date", F.col("record_id").alias("refers_to"),
                       F.col("payload_digest").alias("source_payload_digest"), "http_headers")
    both = both.withColumns({"content_length": F.octet_length("block").cast("bigint"), "block_digest": _digest(F.col("block")),
                             "record_id": _uuid(F.col("warc_type"), F.col("refers_to"))})
    return both.withColumn("headers", F.concat(F.lit(f"WARC/1.1{CRLF}"), _lines(
        ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("warc_date")),
        ("WARC-Target-URI", F.col("target_uri")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Refers-To-Target-URI", F.col("target_uri")), ("WARC-Refers-To-Date", F.col("warc_date")),
        ("WARC-Source-Payload-Digest", F.col("source_payload_digest")), ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string")),
    ))).drop("http_headers", "content_type")


def as_warc(records: DataFrame) -> DataFrame:
    """One ``value`` per record, ready for ``write.text`` with an empty line separator."""
    return records.select(F.concat("headers", F.lit(CRLF), "block", F.lit(CRLF + CRLF)).alias("value"))


DUCK_SQL = r"""
WITH source AS (
    SELECT page_id AS source_key, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, chr(13) || chr(10) AS nl FROM pages
), heads AS (
    SELECT *, 'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || strlen(payload) || nl AS http
    FROM source
), digests AS (
    SELECT *, 'sha256:' || sha256(payload) AS payload_digest, 'sha256:' || sha256(http || nl || payload) AS http_digest FROM heads
), named AS (
    SELECT *, md5('response|' || coalesce(CAST(source_key AS VARCHAR), '') || '|' || target_uri || '|' || http_digest) AS h FROM digests
), linked AS (
    SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS refers_to FROM named
), texts AS (
    SELECT *, regexp_replace(regexp_replace(regexp_replace(payload,
        '(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|<noscript\b[^>]*>.*?(?:</noscript\s*>|\z)|<!--.*?(?:-->|\z)', ' ', 'g'),
        '(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>', chr(10), 'g'),
        '<[a-zA-Z/!?][^>]*>', '', 'g') AS bare
    FROM linked
), decoded AS (
    SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(bare,
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&copy;', '©'), '&reg;', '®'),
        '&middot;', '·'), '&ndash;', '–'), '&mdash;', '—'), '&hellip;', '…'), '&laquo;', '«'), '&raquo;', '»'), '&euro;', '€'), '&amp;', '&') AS readable,
        trim(regexp_replace(coalesce(regexp_extract(payload, '(?is)<title\b[^>]*>([^<]*)', 1), ''), '\s+', ' ', 'g'), ' ') AS title,
        coalesce(regexp_extract(payload, '(?i)<html\b[^>]*?\blang="?([\w-]*)', 1), '') AS lang,
        coalesce(regexp_extract(payload, '(?i)<meta\b[^>]*?\bcharset="?([\w-]*)', 1), '') AS chars,
        len(regexp_extract_all(payload, '(?i)<a\s[^>]*?\bhref=')) AS links
    FROM texts
), blocks AS (
    SELECT *, 'conversion' AS warc_type, 'text/plain; charset=utf-8' AS content_type,
        trim(regexp_replace(regexp_replace(regexp_replace(readable, '[ \t\r\x0b\x0c\x{a0}]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^\n|\n\z', '', 'g'), ' ') AS block
    FROM decoded
    UNION ALL
    SELECT *, 'metadata', 'application/warc-fields',
        CASE WHEN title <> '' THEN 'title: ' || title || nl ELSE '' END || CASE WHEN lang <> '' THEN 'language: ' || lang || nl ELSE '' END
        || CASE WHEN chars <> '' THEN 'charset: ' || chars || nl ELSE '' END || 'outlinks: ' || links || nl
        || 'sourcePayloadDigest: ' || payload_digest || nl || 'sourceBlockDigest: ' || http_digest || nl
        || 'sourceHttpHeaders: ' || trim(replace(http, nl, '; '), ' ') || nl
    FROM decoded
), made AS (
    SELECT source_key, warc_type, block, target_uri, '2024-01-01T00:00:00Z' AS warc_date, refers_to, payload_digest AS source_payload_digest,
        CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, content_type, nl,
        md5(warc_type || '|' || refers_to) AS h
    FROM blocks
), ids AS (
    SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS record_id FROM made
)
SELECT source_key AS page_id, warc_type, block, target_uri, warc_date, refers_to, source_payload_digest, content_length, block_digest, record_id,
    'WARC/1.1' || nl || 'WARC-Type: ' || warc_type || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Date: ' || warc_date || nl
    || CASE WHEN target_uri <> '' THEN 'WARC-Target-URI: ' || target_uri || nl ELSE '' END || 'WARC-Refers-To: ' || refers_to || nl
    || CASE WHEN target_uri <> '' THEN 'WARC-Refers-To-Target-URI: ' || target_uri || nl ELSE '' END || 'WARC-Refers-To-Date: ' || warc_date || nl
    || 'WARC-Source-Payload-Digest: ' || source_payload_digest || nl || 'WARC-Block-Digest: ' || block_digest || nl
    || 'Content-Type: ' || content_type || nl || 'Content-Length: ' || content_length || nl AS headers
FROM ids
"""
