"""Queries of the text layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import messages as M
from .registry import query

# DuckDB spellings of the text rules, shared by several query texts below.
WS = " || ".join(f"chr({ord(c)})" for c in X.WHITE_SPACE)


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {WS})"


def sql_quote(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_clean(expr: str) -> str:
    for pattern in X.FOOTERS:
        expr = f"regexp_replace({expr}, '{pattern}', '', 'gi')"
    return sql_strip(expr)


def sql_fence(expr: str) -> str:
    body = sql_strip(expr)
    return (f"CASE WHEN starts_with({body}, '```') THEN {sql_strip(f'''regexp_replace(split_part({body}, '```', 2), '^json', '')''')}"
            f" ELSE {body} END")


SKIP = f"""CASE WHEN content IS NULL OR {sql_strip('content')} = '' THEN 'blank'
  WHEN length({sql_strip('content')}) < {X.MIN_LENGTH} THEN 'short'
  WHEN lower({sql_strip('content')}) IN ({sql_quote(X.NOISE_PHRASES)}) THEN 'phrase'
  WHEN regexp_matches({sql_strip('content')}, '{X.EMOJI_ONLY}', 'i') THEN 'emoji'
  WHEN subtype IN ({sql_quote(X.BOT_SUBTYPES)}) THEN 'bot_subtype'
  WHEN starts_with(user_id, 'B') THEN 'bot_user' END"""

BUNDLE = """SELECT msg_id, org_id, channel_id, thread_ts, 0 AS part, 0 AS replies, channel_is_private, user_id, subtype, ts, content
    FROM {src} WHERE coalesce(thread_ts, '') = '' OR thread_ts = ts
  UNION ALL
  SELECT min(msg_id), org_id, channel_id, thread_ts, 0, count(*), arg_min(channel_is_private, msg_id), arg_min(user_id, msg_id),
    first(subtype ORDER BY msg_id), arg_min(ts, msg_id), '[Thread]' || chr(10) || string_agg(content, chr(10) || '---' || chr(10) ORDER BY msg_id)
    FROM {src} WHERE coalesce(thread_ts, '') <> '' AND thread_ts <> ts GROUP BY org_id, channel_id, thread_ts"""


@query("T2 T2a T2b", f"SELECT msg_id, {SKIP} AS skip_reason FROM fx_messages")
def noise_reasons(t):
    return M.noise_reasons(t("fx_messages")).select("msg_id", "skip_reason")


@query("T1", f"SELECT msg_id, {sql_clean('content')} AS content FROM fx_messages")
def clean_text(t):
    return M.clean(t("fx_messages")).select("msg_id", "content")


@query("T3 U1", BUNDLE.format(src="fx_messages"))
def bundle_threads(t):
    return M.bundle_threads(t("fx_messages"))


@query("T5", f"""WITH kept AS (SELECT * REPLACE ({sql_clean('content')} AS content) FROM fx_messages WHERE ({SKIP}) IS NULL)
  {BUNDLE.format(src='kept')}""")
def clean_chain(t):
    return M.clean_messages(t("fx_messages"))


@query("T4 J10", """SELECT m.msg_id, CASE WHEN coalesce(p.slack_workspace_domain, '') = '' THEN m.ts
    ELSE 'https://' || replace(p.slack_workspace_domain, '.slack.com', '') || '.slack.com/archives/' || m.channel_id || '/p' || replace(m.ts, '.', '') END AS permalink
  FROM fx_messages m LEFT JOIN fx_profiles p ON p.org_id = m.org_id""")
def permalinks(t):
    domains = t("fx_profiles").select("org_id", "slack_workspace_domain")
    return t("fx_messages").join(domains, "org_id", "left").select(
        "msg_id", X.permalink(F.col("slack_workspace_domain"), F.col("channel_id"), F.col("ts")).alias("permalink")
    )


@query("T6", f"""SELECT query_id, ({' OR '.join(f"contains(lower(question), '{p}')" for p in X.RELATIONSHIP_PHRASES)}) AS wants_relationships
  FROM fx_questions""")
def question_intent(t):
    return t("fx_questions").select(
        "query_id", X.asks_for_relationships(F.col("question")).alias("wants_relationships")
    )


@query("T7", "SELECT id, CASE WHEN length(raw_content) < 300 THEN 'fast' ELSE 'full' END AS model_tier FROM fx_sources")
def model_tier(t):
    return t("fx_sources").select("id", X.model_tier(F.col("raw_content")).alias("model_tier"))


@query("T9", f"SELECT source_id, {sql_fence('reply')} AS body FROM fx_replies")
def fence_strip(t):
    return t("fx_replies").select("source_id", X.strip_fence(X.strip(F.col("reply"))).alias("body"))
