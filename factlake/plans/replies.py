"""Queries of requests, replies and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.replies import BAD_CHECK, BAD_CRITIC
from ..operators import context, replies, requests
from ..operators.evals import scored
from .registry import query
from .text import sql_fence, sql_quote

BODY = sql_fence("reply")
# A reply that is a JSON object, as JSON; null otherwise.
OBJECTS = f"""SELECT *, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body END AS obj FROM (SELECT *, {BODY} AS body FROM {{src}})"""

PARSED = f"""WITH o AS ({OBJECTS.format(src='fx_replies')})"""


@query("T10", f"""{PARSED}, e AS (SELECT source_id, unnest(CAST(json_extract(obj, '$.entities') AS JSON[])) AS item, generate_subscripts(CAST(json_extract(obj, '$.entities') AS JSON[]), 1) - 1 AS pos
    FROM o WHERE json_type(obj, '$.entities') = 'ARRAY')
  SELECT source_id, CAST(pos AS INTEGER) AS pos, item->>'$.entity_type' AS entity_type, item->>'$.name' AS name, item->>'$.content' AS content FROM e""")
def parse_replies(t):
    return replies.explode_entities(replies.parse_extractions(t("fx_replies")), "source_id")


@query("T10", f"""{PARSED}, e AS (SELECT source_id, unnest(CAST(json_extract(obj, '$.relationships') AS JSON[])) AS item FROM o WHERE json_type(obj, '$.relationships') = 'ARRAY')
  SELECT source_id, item->>'$.from_name' AS from_name, item->>'$.from_type' AS from_type, coalesce(item->>'$.relationship_type', 'related_to') AS relationship_type,
    item->>'$.to_name' AS to_name, item->>'$.to_type' AS to_type FROM e""")
def reply_edges(t):
    return replies.explode_edges(replies.parse_extractions(t("fx_replies")), "source_id").drop("pos")


@query("T11", """WITH pos AS (SELECT batch_id, n, reply, unnest(range(n)) AS idx FROM fx_batch_replies),
  arr AS (SELECT batch_id, n, CASE WHEN json_valid(reply) AND json_type(reply) = 'ARRAY' THEN CAST(reply AS JSON[]) ELSE [] END AS items FROM fx_batch_replies),
  item AS (SELECT batch_id, unnest(items) AS item, generate_subscripts(items, 1) AS place FROM arr),
  last AS (SELECT batch_id, CAST(item->>'$.message_index' AS BIGINT) AS idx, arg_max(item, place) AS item FROM item WHERE item->>'$.message_index' IS NOT NULL GROUP BY ALL)
  SELECT p.batch_id, CAST(p.idx AS INTEGER) AS idx, CAST(coalesce(json_array_length(l.item, '$.entities'), 0) AS INTEGER) AS entities,
    coalesce(l.item->>'$.entities[0].name', '') AS first_name FROM pos p LEFT JOIN last l ON l.batch_id = p.batch_id AND l.idx = p.idx""")
def unpack_batch(t):
    return replies.unpack_batches(t("fx_batch_replies")).select(
        "batch_id", "idx", F.size("entities").alias("entities"),
        F.coalesce(F.try_element_at("entities", F.lit(1))["name"], F.lit("")).alias("first_name"))


CRITIC = f"""SELECT seq, coalesce(good AND (CASE json_type(obj, '$.approved') WHEN 'BOOLEAN' THEN obj->>'$.approved' = 'true' WHEN 'VARCHAR' THEN obj->>'$.approved' <> ''
      WHEN 'UBIGINT' THEN obj->>'$.approved' <> '0' END), false) AS approved,
    CASE WHEN good THEN score ELSE 0.0 END AS confidence_score, CASE WHEN good THEN coalesce(obj->>'$.reason', '') ELSE '{BAD_CRITIC}' END AS critic_reason
  FROM (SELECT *, obj IS NOT NULL AND score IS NOT NULL AS good FROM (SELECT *, CASE WHEN json_type(obj, '$.confidence_score') IS NULL THEN 0.5::DOUBLE
    WHEN json_type(obj, '$.confidence_score') = 'BOOLEAN' THEN CASE WHEN obj->>'$.confidence_score' = 'true' THEN 1.0 ELSE 0.0 END
    ELSE try_cast(obj->>'$.confidence_score' AS DOUBLE) END AS score FROM ({OBJECTS.format(src='fx_critic')})))"""


@query("T12", CRITIC)
def critic_verdicts(t):
    return replies.critic_verdicts(t("fx_critic")).drop("reply")


CHECKS = f"""SELECT id, coalesce(obj->>'$.contradiction' = 'true', false) AS contradiction,
  CASE WHEN obj IS NULL THEN '{BAD_CHECK}' ELSE obj->>'$.reason' END AS reason FROM ({OBJECTS.format(src='fx_checks')})"""
BELIEFS = f"""SELECT id, coalesce(obj->>'$.conflict' = 'true', false) AS conflict, coalesce(obj->>'$.belief', '') AS belief, coalesce(obj->>'$.reason', '') AS reason
  FROM ({OBJECTS.format(src='(SELECT id, belief_reply AS reply FROM fx_checks)')})"""


@query("T13", CHECKS)
def contradiction_verdicts(t):
    return replies.contradiction_verdicts(t("fx_checks").select("id", "reply")).drop("reply")


@query("T13", BELIEFS)
def belief_verdicts(t):
    return replies.belief_verdicts(t("fx_checks").select("id", "belief_reply")).drop("belief_reply")


@query("T14", "SELECT id, CASE WHEN contains(upper(verdict), 'PASS') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM fx_golden")
def judge_scores(t):
    return scored(t("fx_golden")).select("id", "score")


def sql_fill(kind: str, **values: str) -> str:
    """The template as SQL concatenation."""
    rest, out = requests.TEMPLATES[kind], []
    while True:
        marks = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not marks:
            break
        at, key = min(marks)
        out += [sql_quote([rest[:at]]), f"coalesce(CAST({values[key]} AS VARCHAR), '')"]
        rest = rest[at + len(key) + 2:]
    return " || ".join([*out, sql_quote([rest])])


@query("T15 T7", f"""SELECT CAST(id AS VARCHAR) AS request_id, 'extraction' AS kind, org_id, CASE WHEN length(raw_content) < 300 THEN 'fast' ELSE 'full' END AS model_tier,
  {sql_fill('extraction', message='raw_content')} AS text FROM fx_sources""")
def extraction_requests(t):
    return requests.extraction_requests(t("fx_sources"))


@query("T15", f"""SELECT CAST(c.seq AS VARCHAR) AS request_id, 'critic' AS kind, c.org_id, 'full' AS model_tier,
  {sql_fill('critic', message='s.raw_content', entity_type='c.entity_type', name='c.name', content='c.content')} AS text FROM fx_candidates c JOIN fx_sources s ON s.id = c.source_id""")
def critic_requests(t):
    return requests.critic_requests(t("fx_candidates"), t("fx_sources").select("id", "raw_content"))


@query("T15", f"""SELECT CAST(id AS VARCHAR) AS request_id, 'judge' AS kind, org_id, 'full' AS model_tier,
  {sql_fill('judge', question='question', expected='expected_answer', actual="'Answer of ' || id")} AS text FROM fx_golden""")
def judge_requests(t):
    return requests.judge_requests(t("fx_golden").withColumn("actual", F.concat(F.lit("Answer of "), F.col("id").cast("string"))))


@query("T15 L8", f"""WITH b AS (SELECT org_id, string_agg('- ' || content, chr(10) ORDER BY id) AS beliefs FROM fx_entities WHERE entity_type = 'Belief' AND superseded_at IS NULL GROUP BY org_id)
  SELECT query_id || '/0' AS request_id, 'belief' AS kind, q.org_id, 'full' AS model_tier, {sql_fill('belief', action='question', beliefs='beliefs')} AS text
  FROM fx_questions q JOIN b ON b.org_id = q.org_id""")
def belief_requests(t):
    return requests.belief_requests(t("fx_questions"), context.belief_blocks(t("fx_entities")))


PACKED = """SELECT id, org_id, raw_content, (rn - 1) // 10 AS batch_no, CAST((rn - 1) % 10 AS INTEGER) AS idx FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY id) AS rn
  FROM fx_sources WHERE source_type = 'slack_history' AND processed_at IS NULL)"""


@query("L10", "SELECT id, org_id, raw_content FROM fx_sources WHERE source_type = 'slack_history' AND processed_at IS NULL")
def backlog(t):
    return requests.backlog(t("fx_sources")).select("id", "org_id", "raw_content")


@query("T16 W4", f"SELECT id, org_id, batch_no, idx FROM ({PACKED})")
def batch_pack(t):
    return requests.pack_batches(requests.backlog(t("fx_sources")).select("id", "org_id"))


@query("T16 T15", f"""WITH p AS ({PACKED}), b AS (SELECT org_id, batch_no, count(*) AS n, string_agg('[' || idx || '] ' || raw_content, chr(10) || chr(10) ORDER BY idx) AS messages FROM p GROUP BY ALL)
  SELECT org_id || '/' || batch_no AS request_id, 'batch' AS kind, org_id, batch_no, n, 'full' AS model_tier, {sql_fill('batch', messages='messages')} AS text FROM b""")
def batch_requests(t):
    rows = requests.backlog(t("fx_sources")).select("id", "org_id", "raw_content")
    return requests.batch_requests(requests.pack_batches(rows))


@query("J7 T11 T16", f"""WITH p AS ({PACKED}) SELECT id AS source_id, 'R' || idx || ' of ' || batch_no AS name FROM p""")
def reply_zip(t):
    # One reply per batch with a fact for every position.
    packed = requests.pack_batches(requests.backlog(t("fx_sources")).select("id", "org_id"))
    made = packed.groupBy("org_id", "batch_no").agg(F.count("*").alias("n"), F.to_json(F.collect_list(
        F.struct(F.col("idx").alias("message_index"), F.array(F.struct(
            F.lit("Client").alias("entity_type"), F.concat(F.lit("R"), F.col("idx").cast("string"), F.lit(" of "), F.col("batch_no").cast("string")).alias("name"),
            F.lit("c").alias("content"))).alias("entities")))).alias("reply"))
    keyed = made.withColumn("batch_id", F.concat_ws("/", "org_id", F.col("batch_no").cast("string")))
    unpacked = replies.unpack_batches(keyed).select(
        F.split_part("batch_id", F.lit("/"), F.lit(1)).alias("org_id"),
        F.split_part("batch_id", F.lit("/"), F.lit(2)).cast("bigint").alias("batch_no"), "idx", "entities")
    zipped = replies.attach_sources(unpacked, packed)
    return zipped.select(F.col("id").alias("source_id"), F.explode("entities").alias("e")).select("source_id", "e.name")
