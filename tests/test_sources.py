"""Importers reading real files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from factlake.operators import messages
from factlake.sources import chat, documents, mail, tables


def save(folder, name, lines):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(lines if isinstance(lines, str) else "\n".join(json.dumps(x) for x in lines))
    return path


def test_csv_small(spark, folder):
    save(folder, "a.csv", 'Name,Company,note\n"Ann, Lee",Acme,"line one\nline two"\n,Beta,\n,,"say ""hi"""\n\nBob,,\n')
    got = tables.csv_facts(tables.read_csv(spark, folder), "o", "Client").orderBy("row_no").collect()
    assert [(r.row_no, r.name, r.content) for r in got] == [
        (1, "Ann, Lee", "Name: Ann, Lee, Company: Acme, note: line one\nline two"),
        (2, "Beta", "Company: Beta"), (3, "Row 3", 'note: say "hi"'), (4, "Bob", "Name: Bob")]
    assert {r.approved_by for r in got} == {"csv_import"}


def test_csv_row_numbers_survive_splits(spark, folder):
    for name, n in (("a.csv", 4000), ("b.csv", 10)):
        save(folder, name, "id,text\n" + "".join(f"{i},row number {i}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = tables.read_csv(spark, folder)
        assert rows.count() == 4010
        assert rows.filter(F.col(tables.ROW_NO) != F.col("id").cast("bigint")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_without_name_columns(spark, folder):
    save(folder, "a.csv", "k,v\n1,\n")
    got = tables.csv_facts(tables.read_csv(spark, folder), "o", "Project").first()
    assert (got.name, got.content) == ("Row 1", "k: 1")


def test_chat_export(spark, folder):
    base = f"{folder}/messages/org_id=o/channel_id=C1"
    day = 1_700_000_000
    long = "this message is long enough to keep"
    save(base, "1.json", [
        {"type": "message", "text": long, "user": "U1", "ts": f"{day}.000100"},
        {"type": "message", "text": "", "user": "U1", "ts": f"{day + 1}.000100"},
        {"type": "file", "text": long, "user": "U1", "ts": f"{day + 2}.000100"},
        {"type": "message", "text": long, "ts": f"{day + 3}.000100", "subtype": "bot_message"},
        {"type": "message", "text": long + " A", "user": "U2", "ts": f"{day + 5}.000100", "thread_ts": f"{day}.000100"},
        {"type": "message", "text": long + " B", "user": "U3", "ts": f"{day + 4}.000100", "thread_ts": f"{day}.000100"},
        {"type": "message", "text": long, "user": "U1", "ts": f"{day - 90000}.000100"},
    ])
    save(folder, "channels/c.json", [{"org_id": "o", "id": "C1", "name": "x", "is_private": True, "members": ["U1", "U1", "U2"]},
                                     {"org_id": "o", "id": "C2", "name": "y", "members": ["U9"]}])
    channels = chat.read_channels(spark, f"{folder}/channels")
    profiles = spark.createDataFrame([("o", "acme")], "org_id string, slack_workspace_domain string")
    now = F.timestamp_seconds(F.lit(day + 3600))
    found = chat.import_messages(chat.read_messages(spark, f"{folder}/messages"), channels, profiles, now, 24)
    assert found.count() == 4
    stored = chat.index_messages(messages.clean_messages(found, slice_width=3_600_000_000), "slack_history", now)
    rows = {r.permalink: r for r in stored.collect()}
    assert set(rows) == {f"https://acme.slack.com/archives/C1/p{day}000100", f"https://acme.slack.com/archives/C1/p{day + 4}000100"}
    bundle = rows[f"https://acme.slack.com/archives/C1/p{day + 4}000100"]
    assert bundle.raw_content == f"[Thread]\n{long} B\n---\n{long} A" and bundle.channel_is_private
    assert bundle.source_metadata["user"] == "U3" and bundle.source_metadata["channel_id"] == "C1"
    old = spark.createDataFrame([("o", "C1", "U2")], "org_id string, channel_id string, user_id string")
    assert [tuple(r) for r in chat.import_memberships(channels, chat.member_rows(channels), old).collect()] == [("o", "C1", "U1")]


def test_mailbox(spark, folder):
    import base64

    def enc(text):
        return base64.urlsafe_b64encode(text if isinstance(text, bytes) else text.encode()).decode()

    ms = 1_700_000_000_000
    plain = {"mimeType": "text/plain", "body": {"data": enc(" Hi \n")}}
    rows = [
        {"id": 1, "org_id": "o", "internalDate": ms, "payload": {**plain, "headers": [
            {"name": "Subject", "value": "a"}, {"name": "From", "value": "x@y"}, {"name": "Subject", "value": "b"}]}},
        {"id": 2, "org_id": "o", "internalDate": ms, "payload": {"mimeType": "multipart/mixed", "headers": [], "parts": [
            {"mimeType": "text/html", "body": {"data": enc("<b>")}}, {"mimeType": "text/plain", "body": {}},
            {"mimeType": "text/plain", "body": {"data": enc(b"ok\xff!")}}, plain]}},
        {"id": 3, "org_id": "o", "internalDate": ms, "payload": {"mimeType": "text/html", "body": {"data": enc("x")}}},
        {"id": 4, "org_id": "o", "internalDate": ms, "labels": ["SPAM"], "payload": plain},
        {"id": 5, "org_id": "o", "internalDate": ms - 90_000_000, "payload": plain},
    ]
    save(folder, "m.json", rows)
    now = F.timestamp_millis(F.lit(ms + 1000))
    raw = mail.read_mailbox(spark, folder)
    got = {r.id: (r.subject, r.sender, r.body) for r in mail.import_mailbox(raw, now, 24).collect()}
    assert got == {1: ("b", "x@y", "Hi"), 2: ("(no subject)", "", "ok!")}
    assert mail.import_mailbox(raw, now, 24, cap=1).count() == 1
    text = mail.mail_sources(mail.import_mailbox(raw, now, 24)).filter("id = 1").first().raw_content
    assert text == "Email from: x@y\nSubject: b\n\nHi"


FRAGMENTS = [
    (1, "a.pdf", 0, None, 0, 0, " page one "), (1, "a.pdf", 1, None, 0, 0, ""), (1, "a.pdf", 2, None, 0, 0, "  "), (1, "a.pdf", 3, None, 0, 0, "page four"),
    (2, "b.DOCX", 0, None, 0, 0, "one"), (2, "b.DOCX", 1, None, 0, 0, "  "), (2, "b.DOCX", 2, None, 0, 0, " two "),
    (3, "c.xlsx", 0, "S1", 0, 0, "a"), (3, "c.xlsx", 0, "S1", 0, 1, None), (3, "c.xlsx", 0, "S1", 0, 2, "c"), (3, "c.xlsx", 0, "S1", 1, 0, None),
    (3, "c.xlsx", 0, "S1", 2, 0, "z"), (3, "c.xlsx", 1, "S2", None, None, None),
    (4, "d.txt", 0, None, 0, 0, "x"), (5, "e.pdf", 0, None, 0, 0, "   "), (6, "none", 0, None, 0, 0, "x"),
]


def fragments(spark):
    return spark.createDataFrame(FRAGMENTS, "doc_id int, filename string, part_no int, part_name string, row_no int, col_no int, text string")


def test_documents(spark):
    got = {r.doc_id: r for r in documents.document_sources(fragments(spark)).collect()}
    assert got[1].raw_content == "page one\n\n\n\npage four"
    assert got[2].raw_content == "one\n\ntwo" and got[2].characters_extracted == 8
    assert got[3].raw_content == "Sheet: S1\na | c\nz\nSheet: S2"
    assert got[4].error == "Unsupported file type: '.txt'. Supported types: .pdf, .xlsx, .docx" and got[4].raw_content is None
    assert got[5].error == documents.NO_TEXT
    assert got[6].error.startswith("Unsupported file type: ''.")


def test_document_is_one_row_at_any_size(spark):
    rows = [(1, "c.xlsx", s, f"S{s}", r, 0, f"v{s}.{r}") for s in range(4) for r in range(30)]
    df = spark.createDataFrame(rows, fragments(spark).schema)
    whole = documents.assemble_text(df).first().raw_content
    assert [r.raw_content for r in documents.assemble_text(df, slice_rows=7).collect()] == [whole]
    assert whole.startswith("Sheet: S0\nv0.0\nv0.1")


def test_file_scan(spark, folder):
    for name in ("x.pdf", "sub/y.XLSX", "z.md"):
        save(folder, name, "bytes")
    got = {r.filename: r.content_type for r in documents.route_files(documents.scan_files(spark, folder)).select("filename", "content_type").collect()}
    assert got["x.pdf"] == documents.SUPPORTED[".pdf"] and got["y.XLSX"] == documents.SUPPORTED[".xlsx"] and got["z.md"] is None


def test_inbound_mail(spark):
    orgs = spark.createDataFrame([(1, "AB12-1"), (2, "ab12-2"), (3, "ff-3")], "id int, org_uuid string")
    mails = spark.createDataFrame([
        (1, "ab12@in", "s", "t", "body", ""), (2, " FF-3 @in", "s", None, "body", " short "), (3, "no@in", "s", "t", "b", "b"),
        (4, "ff@in", "s", "t", " ", None), (5, "ab12-2", "s", "t", "b", " ")],
        "id int, recipient string, sender string, subject string, body_plain string, stripped_text string")
    got = {r.id: (r.matched_org, r.outcome, r.raw_content) for r in mail.route_inbound(mails, orgs).collect()}
    assert got == {
        1: ("ab12-1", "processed", "Email from: s\nSubject: t\n\nbody"), 2: ("ff-3", "processed", "Email from: s\nSubject: \n\nshort"),
        3: (None, "ignored: unknown recipient", None), 4: ("ff-3", "ignored: empty body", None), 5: ("ab12-2", "processed", "Email from: s\nSubject: t\n\nb")}


@pytest.mark.parametrize("kind", ["contact", "deal"])
def test_crm_defaults(spark, kind):
    if kind == "contact":
        df = spark.createDataFrame([(1, "o", None, "Lee", None, None)], "id int, org_id string, firstName string, lastName string, email string, company string")
        got = tables.crm_contacts(df).first()
        assert (got.name, got.content, got.entity_type) == ("Lee", "Name: Lee. Email: . Company: .", "Person")
    else:
        df = spark.createDataFrame([(1, "o", None, "won", "5")], "id int, org_id string, dealname string, dealstage string, amount string")
        got = tables.crm_deals(df).first()
        assert (got.name, got.content, got.entity_type) == ("Unnamed deal", "Deal: Unnamed deal. Stage: won. Amount: 5.", "Project")
