"""Text rules on hand-written edge rows."""

import base64

import pytest
from pyspark.sql import functions as F

from factlake.functions import replies as R
from factlake.functions import text as X
from factlake.functions.times import age_text, epoch_to_ts, percent

LONG = "a message that is long enough to keep"

NOISE = [
    (None, None, "U1", "blank"),
    ("", None, "U1", "blank"),
    (" \t\n", None, "U1", "blank"),
    ("　  ", None, "U1", "blank"),
    ("x" * 24, None, "U1", "short"),
    ("  " + "x" * 24 + "  ", None, "U1", "short"),
    ("x" * 25, None, "U1", None),
    ("\U0001F600" * 24, None, "U1", "short"),
    ("\U0001F389 " * 20, None, "U1", "emoji"),
    (":tada: :party_popper: :white_check_mark:", None, "U1", "emoji"),
    ("Please Read The Following Lines:", None, "U1", "emoji"),
    ("please read the following 3 lines:", None, "U1", None),
    (LONG, "bot_message", "U1", "bot_subtype"),
    (LONG, "channel_join", "U1", "bot_subtype"),
    (LONG, "channel_leave", "B1", "bot_subtype"),
    (LONG, "channel_topic", "U1", "bot_subtype"),
    (LONG, "channel_purpose", "U1", "bot_subtype"),
    (LONG, "file_share", "U1", None),
    (LONG, None, "B77", "bot_user"),
    (LONG, None, "", None),
    (LONG, None, None, None),
    ("Thanks", None, "U1", "short"),
]


def test_noise_rules(spark):
    rows = [(i, *r) for i, r in enumerate(NOISE)]
    df = spark.createDataFrame(rows, "i int, content string, subtype string, user string, want string")
    got = df.select("i", "want", X.skip_reason(F.col("content"), F.col("subtype"), F.col("user")).alias("got")).collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want) for r in got]


FOOTERS = [
    ("done *Sent using* Claude.", "done"),
    ("done sent USING claude", "done"),
    ("Sent via Claude. done", "done"),
    ("*Powered by*  Claude done", "done"),
    ("a Sent using ChatGPT. b", "a  b"),
    ("a *Sent via* ChatGPT", "a"),
    ("ok Sent with FancyAI.", "ok"),
    ("ok Sent with ÜberAI", "ok"),
    ("ok Sent with AI", "ok Sent with AI"),
    ("Sent using Claude", "Sent using Claude"),
    ("x Sent using Claude", "x"),
    ("Sent using Sent via Claude.Claude", "Sent using Claude"),
    ("  plain  ", "plain"),
    ("Sent using Claude.", ""),
]


def test_footers(spark):
    df = spark.createDataFrame(FOOTERS, "t string, want string")
    got = df.select("t", "want", X.clean_text(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]


@pytest.mark.parametrize("reply, want", [
    ('```json\n{"a": 1}\n```', '{"a": 1}'), ('```\nx\n``` y', "x"), ("  plain ", "plain"), ("```", ""),
    ("a ```b```", "a ```b```"), ("```jsonjson x```", "json x"),
])
def test_fences(spark, reply, want):
    assert spark.range(1).select(X.strip_fence(X.strip(F.lit(reply)))).first()[0] == want


CRITIC = [
    ('{"approved": true, "confidence_score": 0.9, "reason": "x"}', (True, 0.9, "x")),
    ('```json\n{"approved": true, "confidence_score": 0.7}\n```', (True, 0.7, "")),
    ('{"approved": true}', (True, 0.5, "")),
    ('{"confidence_score": "0.8"}', (False, 0.8, "")),
    ('{"confidence_score": true}', (False, 1.0, "")),
    ('{"approved": "yes", "confidence_score": 1}', (True, 1.0, "")),
    ('{"approved": "", "confidence_score": 1}', (False, 1.0, "")),
    ('{"approved": [], "confidence_score": 1}', (False, 1.0, "")),
    ('{"approved": {"a": 1}, "confidence_score": 1}', (True, 1.0, "")),
    ('{"confidence_score": "high"}', (False, 0.0, R.BAD_CRITIC)),
    ('{"confidence_score": null}', (False, 0.0, R.BAD_CRITIC)),
    ("[1]", (False, 0.0, R.BAD_CRITIC)),
    ("nonsense", (False, 0.0, R.BAD_CRITIC)),
    ('{"confidence_score": 0.1, "confidence_score": 0.6}', (False, 0.6, "")),
]


def test_critic_verdicts(spark):
    df = spark.createDataFrame([(r,) for r, _ in CRITIC], "reply string")
    got = [tuple(r.v) for r in df.select(R.critic_verdict(R.parsed(F.col("reply"))).alias("v")).collect()]
    assert got == [w for _, w in CRITIC]


def test_small_functions(spark):
    bad = base64.urlsafe_b64encode("héllo?>".encode() + b"\xff").decode()
    row = spark.range(1).select(
        X.decode_base64url(F.lit(bad)).alias("mail"),
        X.permalink(F.lit("acme.slack.com"), F.lit("C1"), F.lit("1.25")).alias("link"),
        X.permalink(F.lit(None).cast("string"), F.lit("C1"), F.lit("1.25")).alias("bare"),
        X.extension(F.lit("a.b.PDF")).alias("ext"), X.extension(F.lit("README")).alias("none"),
        X.inbound_address(F.lit("ab12-cd"), "in.io").alias("addr"),
        epoch_to_ts(F.lit("1683456789.123456")).cast("string").alias("ts"),
        age_text(F.lit(None).cast("timestamp"), F.current_timestamp()).alias("never"),
        percent(F.lit(1), F.lit(3)).alias("third"),
        X.asks_for_relationships(F.lit("WHO OWNS it")).alias("asks"),
    ).first()
    assert tuple(row) == (
        "héllo?>", "https://acme.slack.com/archives/C1/p125", "1.25", ".pdf", "", "ab12@in.io",
        "2023-05-07 10:53:09.123456", "Never", 33.3, True)
