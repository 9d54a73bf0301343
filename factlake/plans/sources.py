"""Queries of the importers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import messages as M
from ..session import fresh_path
from ..sources import chat, documents, mail, tables
from .registry import query
from .text import BUNDLE, SKIP, sql_clean, sql_strip


def now():
    return F.expr("timestamp_ntz'2024-01-31 00:00:00'")


def export_now():
    return F.expr("timestamp_ntz'2023-12-05 00:00:00'")


EXPORT_OLDEST = "1701734400 - {hours} * 3600"

IMPORT = """SELECT e.org_id, e.channel_id, coalesce(c.is_private, false) AS channel_is_private, coalesce(e.user, '') AS user_id,
    e.subtype, e.ts, e.thread_ts, e.text AS content, CAST(replace(e.ts, '.', '') AS BIGINT) AS msg_id,
    CASE WHEN coalesce(p.slack_workspace_domain, '') = '' THEN e.ts ELSE 'https://' || replace(p.slack_workspace_domain, '.slack.com', '')
      || '.slack.com/archives/' || e.channel_id || '/p' || replace(e.ts, '.', '') END AS permalink
  FROM fx_export e LEFT JOIN fx_channels c ON c.org_id = e.org_id AND c.id = e.channel_id LEFT JOIN fx_profiles p ON p.org_id = e.org_id
  WHERE e.type = 'message' AND e.text <> '' AND CAST(e.ts AS DOUBLE) >= """


@query("S1", """SELECT msg_id AS id, org_id, 'slack_history' AS source_type, content AS raw_content, user_id AS meta_user, ts AS meta_ts,
    CAST(TIMESTAMP '2024-01-31 00:00:00' AS TIMESTAMP) AS timestamp, channel_id, channel_is_private FROM fx_messages""")
def raw_index(t):
    rows = chat.index_messages(t("fx_messages"), "slack_history", now())
    return rows.select(
        "id", "org_id", "source_type", "raw_content", F.col("source_metadata")["user"].alias("meta_user"),
        F.col("source_metadata")["ts"].alias("meta_ts"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        "channel_id", "channel_is_private",
    )


@query("S1", "SELECT org_id, count(*) AS indexed FROM fx_messages GROUP BY org_id")
def raw_index_counts(t):
    return chat.index_messages(t("fx_messages"), "slack_history", now()).groupBy("org_id").agg(F.count("*").alias("indexed"))


def imported(t, hours: float = 180 * 24):
    return chat.import_messages(t("fx_export"), t("fx_channels"), t("fx_profiles"), export_now(), hours)


@query("S2 S3 T4 J10 L11", IMPORT + EXPORT_OLDEST.format(hours=480))
def chat_import(t):
    return imported(t, 480).drop("timestamp")


@query("S3", "SELECT org_id, id, name, coalesce(is_private, false) AS is_private FROM fx_channels")
def channel_list(t):
    return chat.list_channels(t("fx_channels"))


@query("S4 M6", """SELECT DISTINCT m.org_id, m.channel_id, m.user_id FROM fx_channel_members m
  JOIN fx_channels c ON c.org_id = m.org_id AND c.id = m.channel_id WHERE c.is_private
  AND NOT EXISTS (SELECT 1 FROM fx_memberships x WHERE x.org_id = m.org_id AND x.channel_id = m.channel_id AND x.user_id = m.user_id)""")
def membership_import(t):
    return chat.import_memberships(t("fx_channels"), t("fx_channel_members"), t("fx_memberships"))


@query("ST7 S2 S4 T5 S1", f"""WITH found AS ({IMPORT}{EXPORT_OLDEST.format(hours=180 * 24)}),
  kept AS (SELECT msg_id, org_id, channel_id, thread_ts, channel_is_private, user_id, subtype, ts, {sql_clean('content')} AS content FROM found WHERE ({SKIP}) IS NULL),
  bundled AS ({BUNDLE.format(src='kept')})
  SELECT msg_id AS id, org_id, channel_id, content AS raw_content, 'slack_history' AS source_type FROM bundled""")
def backfill_run(t):
    bundles = M.clean_messages(imported(t), slice_width=3_600_000_000)
    return chat.index_messages(bundles, "slack_history", export_now()).select("id", "org_id", "channel_id", "raw_content", "source_type")


RAW_MAIL = """SELECT doc_id AS id, 'org' || (doc_id % 4) AS org_id,
  CASE doc_id % 11 WHEN 0 THEN array('INBOX', 'SPAM') WHEN 1 THEN array('TRASH') WHEN 2 THEN NULL ELSE array('INBOX') END AS labels,
  1706659200000 - doc_id * 7919 % 43200 * 60000 AS internalDate,
  named_struct('mimeType', CASE WHEN doc_id % 2 = 0 THEN 'text/plain' ELSE 'multipart/alternative' END,
    'headers', CASE doc_id % 3 WHEN 0 THEN array(named_struct('name', 'Subject', 'value', 'old'), named_struct('name', 'From', 'value', source || '@example.com'), named_struct('name', 'Subject', 'value', 'Mail ' || doc_id))
      WHEN 1 THEN array(named_struct('name', 'From', 'value', source || '@example.com')) ELSE array(named_struct('name', 'Subject', 'value', 'Only subject')) END,
    'body', named_struct('data', CASE WHEN doc_id % 2 = 0 AND doc_id % 10 > 0 THEN translate(base64(encode(text, 'utf-8')), '+/', '-_') END),
    'parts', CASE WHEN doc_id % 2 = 1 THEN array(
      named_struct('mimeType', 'text/html', 'body', named_struct('data', 'PGI-')), named_struct('mimeType', 'text/plain', 'body', named_struct('data', '')),
      named_struct('mimeType', 'text/plain', 'body', named_struct('data', translate(base64(encode(text, 'utf-8')), '+/', '-_'))),
      named_struct('mimeType', 'text/plain', 'body', named_struct('data', 'bGFzdA=='))) END) AS payload
  FROM documents"""

MAILBOX = f"""WITH listed AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS rn FROM documents
    WHERE doc_id % 11 > 1 AND 1706659200000 - doc_id * 7919 % 43200 * 60000 >= (1706659200 - 360 * 3600) * CAST(1000 AS BIGINT)),
  mails AS (SELECT doc_id AS id, 'org' || (doc_id % 4) AS org_id, CASE doc_id % 3 WHEN 0 THEN 'Mail ' || doc_id WHEN 1 THEN '(no subject)' ELSE 'Only subject' END AS subject,
    CASE WHEN doc_id % 3 < 2 THEN source || '@example.com' ELSE '' END AS sender, CASE WHEN doc_id % 10 = 0 THEN '' ELSE {sql_strip('text')} END AS body,
    epoch_ms(1706659200000 - doc_id * 7919 % 43200 * 60000) AS timestamp FROM listed)"""


def mailbox(t):
    return mail.import_mailbox(t.sql(RAW_MAIL), now(), since_hours=360)


@query("S5 T8 L11", f"{MAILBOX} SELECT * FROM mails WHERE body <> ''")
def mailbox_import(t):
    return mailbox(t).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("S6", f"""{MAILBOX} SELECT id, org_id, 'email' AS source_type, 'Email from: ' || sender || chr(10) || 'Subject: ' || subject || chr(10) || chr(10) || body AS raw_content,
    sender AS meta_sender, subject AS meta_subject FROM mails WHERE body <> ''""")
def mail_sources(t):
    return mail.mail_sources(mailbox(t)).select(
        "id", "org_id", "source_type", "raw_content", F.col("source_metadata")["sender"].alias("meta_sender"),
        F.col("source_metadata")["subject"].alias("meta_subject"))


@query("T8", f"SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE {sql_strip('text')} END AS body FROM documents")
def mail_body(t):
    return t.sql(RAW_MAIL).select("id", mail.body_text().alias("body"))


@query("S7", f"""WITH keys AS (SELECT org_uuid AS address, id, org_uuid FROM fx_profiles UNION ALL SELECT split_part(org_uuid, '-', 1), id, org_uuid FROM fx_profiles),
  addresses AS (SELECT address, arg_min(org_uuid, id) AS matched_org FROM keys GROUP BY address),
  mails AS (SELECT *, lower({sql_strip("split_part(recipient, '@', 1)")}) AS address,
    CASE WHEN {sql_strip('stripped_text')} <> '' THEN {sql_strip('stripped_text')} ELSE {sql_strip('body_plain')} END AS body FROM fx_inbound)
  SELECT m.id, recipient, sender, subject, matched_org,
    CASE WHEN matched_org IS NULL THEN 'ignored: unknown recipient' WHEN body = '' THEN 'ignored: empty body' ELSE 'processed' END AS outcome,
    CASE WHEN matched_org IS NOT NULL AND body <> '' THEN 'Email from: ' || sender || chr(10) || 'Subject: ' || subject || chr(10) || chr(10) || body END AS raw_content
  FROM mails m LEFT JOIN addresses a ON a.address = m.address""")
def inbound_mail(t):
    return mail.route_inbound(t("fx_inbound"), t("fx_profiles"))


@query("S8", "SELECT org_id, split_part(org_uuid, '-', 1) || '@in.example.com' AS address FROM fx_profiles")
def inbound_address(t):
    return t("fx_profiles").select("org_id", X.inbound_address(F.col("org_uuid"), "in.example.com").alias("address"))


# Each upload is one file; with more parts there are more uploads.
CSV_NAME = """CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'A "quoted", ' || p_name WHEN p_partkey % 5 = 0 THEN p_name || chr(10) || 'second "line"' ELSE p_name END"""
CSV_ROWS = f"""SELECT floor(p_partkey / 700) AS upload, {CSV_NAME} AS name,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS Company, p_type AS kind, CAST(p_size AS STRING) AS size, p_partkey FROM part"""


@query("S9", f"""WITH raw AS (SELECT CAST(floor(p_partkey / 700) AS BIGINT) AS upload, {CSV_NAME} AS name,
    CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS company, p_type AS kind, CAST(p_size AS VARCHAR) AS size, p_partkey FROM part),
  numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY upload ORDER BY p_partkey) AS BIGINT) AS row_no FROM raw)
  SELECT upload, row_no, 'org0' AS org_id, 'Client' AS entity_type, CASE WHEN name <> '' THEN name WHEN company <> '' THEN company ELSE 'Row ' || row_no END AS name,
    concat_ws(', ', CASE WHEN name <> '' THEN 'name: ' || name END, CASE WHEN company <> '' THEN 'Company: ' || company END,
      CASE WHEN kind <> '' THEN 'kind: ' || kind END, CASE WHEN size <> '' THEN 'size: ' || size END) AS content,
    'csv_import' AS source_type, 'csv_import' AS approved_by FROM numbered""")
def csv_import(t):
    # The uploads are written here from the part table, each in key order by one task.
    path = fresh_path(t.spark, "csv")
    rows = t.sql(CSV_ROWS).repartition("upload").sortWithinPartitions("upload", "p_partkey").drop("p_partkey")
    rows.write.partitionBy("upload").csv(path, header=True, escape='"')
    facts = tables.csv_facts(tables.read_csv(t.spark, path), "org0", "Client")
    return facts.select(F.regexp_extract("file", "upload=([0-9]+)", 1).cast("bigint").alias("upload"), *[c for c in facts.columns if c != "file"])


CONTACTS = """SELECT id, org_id, 'Person' AS entity_type, trim(coalesce(firstName, '') || ' ' || coalesce(lastName, '')) AS name,
  'Name: ' || trim(coalesce(firstName, '') || ' ' || coalesce(lastName, '')) || '. Email: ' || coalesce(email, '') || '. Company: ' || coalesce(company, '') || '.' AS content,
  'hubspot_contact' AS source_type, 'nango_import' AS approved_by FROM fx_contacts"""
DEALS = """SELECT id, org_id, 'Project' AS entity_type, coalesce(dealname, 'Unnamed deal') AS name,
  'Deal: ' || coalesce(dealname, 'Unnamed deal') || '. Stage: ' || coalesce(dealstage, '') || '. Amount: ' || coalesce(amount, '') || '.' AS content,
  'hubspot_deal' AS source_type, 'nango_import' AS approved_by FROM fx_deals"""


@query("S10", CONTACTS)
def crm_contacts(t):
    return tables.crm_contacts(t("fx_contacts"))


@query("S11", DEALS)
def crm_deals(t):
    return tables.crm_deals(t("fx_deals"))


@query("S12 U1", f"""WITH a AS ({CONTACTS}), b AS ({DEALS}) SELECT org_id, count(*) FILTER (WHERE source_type = 'hubspot_contact') AS contacts,
  count(*) FILTER (WHERE source_type = 'hubspot_deal') AS deals FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY org_id""")
def crm_summary(t):
    return tables.crm_summary(t("fx_contacts"), t("fx_deals"))


@query("S10 S11 U1", f"""WITH a AS ({CONTACTS}), b AS ({DEALS}), x AS (SELECT * FROM a UNION ALL SELECT * FROM b)
  SELECT 'source' AS side, id, org_id, source_type AS kind, content FROM x UNION ALL SELECT 'entity', id, org_id, entity_type, content FROM x""")
def crm_import(t):
    facts = tables.crm_contacts(t("fx_contacts")).unionByName(tables.crm_deals(t("fx_deals")))
    src = tables.source_rows(facts, "id").select(
        F.lit("source").alias("side"), "id", "org_id", F.col("source_type").alias("kind"), F.col("raw_content").alias("content"))
    ent = tables.entity_rows(facts, "id").select(
        F.lit("entity").alias("side"), "id", "org_id", F.col("entity_type").alias("kind"), "content")
    return src.unionByName(ent)


FILES = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'report.v' || page_id || '.PDF' WHEN 1 THEN 'sheet' || page_id || '.xlsx' WHEN 2 THEN 'memo.docx'
  WHEN 3 THEN 'notes.txt' WHEN 4 THEN 'README' ELSE regexp_replace(url, '^.*/', '') END AS filename FROM pages"""


@query("S13", f"""WITH f AS ({FILES}), e AS (SELECT *, CASE WHEN contains(filename, '.') THEN '.' || lower(regexp_extract(filename, '([^.]*)$', 1)) ELSE '' END AS extension FROM f)
  SELECT page_id, filename, extension, CASE extension WHEN '.pdf' THEN 'application/pdf' WHEN '.xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
    WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END AS content_type,
    CASE WHEN extension NOT IN ('.pdf', '.xlsx', '.docx') THEN 'Unsupported file type: ''' || extension || '''. Supported types: .pdf, .xlsx, .docx' END AS error FROM e""")
def doc_routing(t):
    return documents.route_files(t.sql(FILES))


NAMED = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'd' || doc_id || '.pdf' WHEN 1 THEN 'd' || doc_id || '.docx' WHEN 2 THEN 'd' || doc_id || '.xlsx' ELSE 'd' || doc_id || '.txt' END AS filename,
  CASE WHEN doc_id % 50 = 0 THEN '   ' ELSE text END AS text FROM documents"""

# Lines become pages, paragraphs or sheet rows; words become cells.
FRAGMENTS = f"""SELECT doc_id, filename, line_no AS part_no, CAST(NULL AS STRING) AS part_name, 0 AS row_no, 0 AS col_no, line AS text
    FROM (SELECT doc_id, filename, posexplode(split(text, '\\n')) AS (line_no, line) FROM ({NAMED}) a WHERE filename NOT LIKE '%.xlsx') b
  UNION ALL SELECT doc_id, filename, line_no % 2, 'S' || (line_no % 2), line_no, col_no, CASE WHEN word <> '' THEN word END
    FROM (SELECT doc_id, filename, line_no, posexplode(split(line, ' ')) AS (col_no, word)
      FROM (SELECT doc_id, filename, posexplode(split(text, '\\n')) AS (line_no, line) FROM ({NAMED}) c WHERE filename LIKE '%.xlsx') d) e"""

ASSEMBLED = f"""WITH named AS ({NAMED}), lines AS (SELECT doc_id, filename, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM named),
  flat AS (SELECT doc_id, filename, line_no AS part_no, 0 AS row_no, {sql_strip('line')} AS line FROM lines
    WHERE (filename LIKE '%.pdf' AND line <> '') OR (filename LIKE '%.docx' AND {sql_strip('line')} <> '')),
  cells AS (SELECT doc_id, filename, line_no, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) AS col_no FROM lines WHERE filename LIKE '%.xlsx'),
  rows AS (SELECT doc_id, filename, line_no % 2 AS part_no, line_no AS row_no, string_agg(word, ' | ' ORDER BY col_no) AS line FROM cells WHERE word <> '' GROUP BY ALL),
  titles AS (SELECT DISTINCT doc_id, filename, line_no % 2 AS part_no, -1 AS row_no, 'Sheet: S' || (line_no % 2) AS line FROM cells),
  texts AS (SELECT doc_id, filename, string_agg(line, chr(10) || chr(10) ORDER BY part_no) AS raw_content FROM flat GROUP BY ALL
    UNION ALL SELECT doc_id, filename, string_agg(line, chr(10) ORDER BY part_no, row_no) FROM (SELECT * FROM rows UNION ALL SELECT * FROM titles) GROUP BY ALL)"""


@query("S14", f"{ASSEMBLED} SELECT doc_id, filename, CAST(0 AS BIGINT) AS part, raw_content FROM texts")
def doc_assembly(t):
    return documents.assemble_text(t.sql(FRAGMENTS))


@query("S15 S13 S14", f"""{ASSEMBLED} SELECT n.doc_id, n.filename, CAST(0 AS BIGINT) AS part, e.error,
    CASE WHEN e.error IS NULL THEN 'document' END AS source_type, CASE WHEN e.error IS NULL THEN t.raw_content END AS raw_content,
    CASE WHEN e.error IS NULL THEN length(t.raw_content) END AS characters_extracted
  FROM named n LEFT JOIN texts t ON t.doc_id = n.doc_id
  JOIN (SELECT n2.doc_id, CASE WHEN n2.filename LIKE '%.txt' THEN 'Unsupported file type: ''.txt''. Supported types: .pdf, .xlsx, .docx'
    WHEN coalesce({sql_strip('t2.raw_content')}, '') = '' THEN 'No text could be extracted from this file.' END AS error
    FROM named n2 LEFT JOIN texts t2 ON t2.doc_id = n2.doc_id) e ON e.doc_id = n.doc_id""")
def doc_sources(t):
    return documents.document_sources(t.sql(FRAGMENTS))


MANUAL = """SELECT item_id AS id, 'org' || (item_id % 4) AS org_id, 'manual' AS source_type, text AS raw_content, 'Process' AS entity_type,
  CASE WHEN item_id % 2 = 0 THEN 'Item ' || item_id END AS entity_name, CASE WHEN item_id % 3 > 0 THEN 'lead' END AS approved_by,
  CASE WHEN item_id % 5 > 0 THEN 'https://example.com/' || item_id END AS permalink FROM benchmark"""


@query("S16", f"""WITH m AS ({MANUAL}) SELECT id, org_id, source_type, raw_content AS content, entity_type, entity_name AS name, approved_by, permalink FROM m""")
def manual_ingest(t):
    return tables.manual_facts(t.sql(MANUAL))


@query("S17", """SELECT 'org' || (l.doc_id % 4) AS org_id, 'Decision' AS entity_type, 'Promoted from history' AS name, s.raw_content AS content,
    s.id AS source_id, 'quality ' || l.quality AS approved_by, 'active' AS status FROM labels l JOIN fx_sources s ON s.id = l.doc_id""")
def promote_sources(t):
    asked = t("labels").select(F.col("doc_id").alias("source_id"), F.concat(F.lit("org"), (F.col("doc_id") % 4).cast("string")).alias("org_id"),
                               F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("approved_by"))
    return tables.promote_sources(t("fx_sources"), asked)
