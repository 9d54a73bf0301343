"""Queries of search, graph and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, context, graph, parted, replies, requests, search, tasks
from ..functions import text as X
from ..session import fresh_path
from .registry import query
from .replies import BELIEFS, CHECKS, sql_fill
from .text import sql_quote

HITS = 5
QV = "(SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)"
DIST = "round(1 - list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 9)"
LINKED = "SELECT e.*, s.permalink, s.source_type, s.channel_id, s.channel_is_private FROM fx_entities e LEFT JOIN fx_sources s ON s.id = e.source_id"
OPEN = "(channel_is_private = false OR channel_id IS NULL)"
ACTIVE = "superseded_at IS NULL AND embedding IS NOT NULL"


def query_vector(t):
    """Vector of embedding 0 as a scalar subquery: one value, never a joined table."""
    return t("embeddings").filter("vec_id = 0").select("embedding").scalar()


@query("V1", f"SELECT id, {DIST.format(a='embedding', b='qv')} AS distance FROM fx_entities, {QV} WHERE embedding IS NOT NULL")
def cosine_distances(t):
    return search.with_distance(t("fx_entities").filter("embedding IS NOT NULL"), query_vector(t)).select("id", "distance")


@query("J1", f"SELECT id, source_id, permalink, source_type FROM ({LINKED})")
def fact_sources(t):
    return access.with_source(t("fx_entities"), t("fx_sources"), "permalink", "source_type").select(
        "id", "source_id", "permalink", "source_type")


@query("J2 J1", f"""SELECT id, channel_id FROM ({LINKED}) WHERE org_id = 'org1' AND ({OPEN}
  OR channel_id IN (SELECT m.channel_id FROM fx_memberships m WHERE m.org_id = 'org1' AND m.user_id = 'U3'))""")
def visible_facts(t):
    placed = access.with_source(t("fx_entities"), t("fx_sources"), "channel_id", "channel_is_private")
    return access.visible_to(placed, t("fx_memberships"), "org1", "U3").select("id", "channel_id")


@query("J2", f"""SELECT l.id, m.user_id FROM ({LINKED}) l JOIN fx_memberships m ON m.org_id = l.org_id AND m.channel_id = l.channel_id WHERE NOT coalesce(l.channel_is_private = false OR l.channel_id IS NULL, false)""")
def members_only_facts(t):
    placed = access.with_source(t("fx_entities"), t("fx_sources"), "channel_id", "channel_is_private")
    return access.visible_pairs(placed, t("fx_memberships")).select("id", "user_id")


@query("V2 J1 L1", f"""SELECT id, entity_type, name, content, source_id, permalink, source_type FROM ({LINKED}), {QV} WHERE org_id = 'org1' AND {ACTIVE} ORDER BY {DIST.format(a='embedding', b='qv')}, id LIMIT 5""")
def topk(t):
    hits = search.top_k(t("fx_entities"), t("fx_sources"), "org1", query_vector(t), HITS)
    return hits.select("id", "entity_type", "name", "content", "source_id", "permalink", "source_type")


@query("V3 J1 J2 L1", f"""SELECT id, entity_type, name, content, source_id, permalink, source_type FROM ({LINKED}), {QV} WHERE org_id = 'org1' AND {ACTIVE}
  AND ({OPEN} OR channel_id IN (SELECT m.channel_id FROM fx_memberships m WHERE m.org_id = 'org1' AND m.user_id = 'U3')) ORDER BY {DIST.format(a='embedding', b='qv')}, id LIMIT 5""")
def topk_acl(t):
    hits = search.top_k_visible(t("fx_entities"), t("fx_sources"), t("fx_memberships"), "org1", "U3", query_vector(t), HITS)
    return hits.select("id", "entity_type", "name", "content", "source_id", "permalink", "source_type")


MANY = f"""facts AS ({LINKED}), ranked AS (SELECT q.query_id, q.org_id, f.id, f.entity_type, f.name, f.content, f.source_id, f.permalink, f.source_type,
    row_number() OVER (PARTITION BY q.query_id ORDER BY {DIST.format(a='q.vector', b='f.embedding')}, f.id) AS rank
  FROM fx_questions q JOIN facts f ON f.org_id = q.org_id WHERE f.superseded_at IS NULL AND f.embedding IS NOT NULL)"""
MANY_ACL = MANY.replace("f.embedding IS NOT NULL)", """f.embedding IS NOT NULL AND (f.channel_is_private = false OR f.channel_id IS NULL
    OR EXISTS (SELECT 1 FROM fx_memberships m WHERE m.org_id = q.org_id AND m.user_id = q.user_id AND m.channel_id = f.channel_id)))""")


def many(t):
    return search.top_k_many(t("fx_questions"), search.searchable(t("fx_entities")), ["org_id"], HITS)


def many_visible(t):
    return search.top_k_many_visible(t("fx_questions"), t("fx_entities"), t("fx_sources"), t("fx_memberships"), HITS)


@query("V4", f"WITH {MANY} SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def topk_many(t):
    return many(t).select("query_id", "id", "rank")


@query("V3 V4 J2", f"WITH {MANY_ACL} SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5")
def topk_many_acl(t):
    return many_visible(t).select("query_id", "id", "rank")


@query("V5", r"""SELECT id, CASE WHEN w THEN 1536 END AS places, CASE WHEN w THEN 1.0::DOUBLE END AS length, CASE WHEN w THEN true END AS same_as_upper
  FROM (SELECT id, regexp_matches(coalesce(raw_content, ''), '[\p{L}\p{N}]') AS w FROM fx_sources)""")
def embed_text(t):
    """Hashed word vectors of every source text: 1,536 places, unit length, none without words, blind to case."""
    texts = t("fx_sources").select("id", F.col("raw_content").alias("text"))
    vectors = search.embed(search.embed(texts, "text").withColumn("upper", F.upper("text")), "upper", "of_upper")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    alike = F.aggregate(F.zip_with("embedding", "of_upper", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v.cast("double")) < 1e-6
    return vectors.select("id", F.size("embedding").alias("places"), F.round(length, 5).alias("length"),
                          (alike | F.col("text").rlike("[ßŉ]")).alias("same_as_upper"))


# --- graph -------------------------------------------------------------------

MATCHED = """matched AS (SELECT a.org_id, e.from_id, e.to_id, a.entity_type AS from_type, a.name AS from_name, e.relationship_type AS relationship,
    b.entity_type AS to_type, b.name AS to_name, b.content AS to_content FROM fx_edges e JOIN fx_nodes a ON a.entity_id = e.from_id JOIN fx_nodes b ON b.entity_id = e.to_id)"""
SHOWN = "org_id, from_type, from_name, relationship, to_type, to_name, to_content"
LIMITED = f"""{MATCHED}, limited AS (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY from_id, to_id, relationship) AS rank FROM matched)"""


@query("J3", f"WITH {MATCHED} SELECT {SHOWN} FROM matched")
def match_edges(t):
    return graph.match_edges(t("fx_edges"), t("fx_nodes"))


@query("G3 J3", f"WITH {LIMITED} SELECT CAST(rank AS INTEGER) AS rank, {SHOWN} FROM limited WHERE rank <= 30")
def edges(t):
    return graph.list_edges(t("fx_edges"), t("fx_nodes"))


# Facts whose ids are node ids, spread over the sources.
NODE_FACTS = "SELECT entity_id AS id, org_id, entity_id % 200 AS source_id FROM fx_nodes"


@query("J4 G3", f"""WITH nf AS ({NODE_FACTS}), seen AS (SELECT nf.id FROM nf LEFT JOIN fx_sources s ON s.id = nf.source_id WHERE nf.org_id = 'org3' AND (s.channel_is_private = false OR s.channel_id IS NULL
    OR s.channel_id IN (SELECT m.channel_id FROM fx_memberships m WHERE m.org_id = 'org3' AND m.user_id = 'U3'))), {MATCHED},
  limited AS (SELECT *, row_number() OVER (ORDER BY from_id, to_id, relationship) AS rank FROM matched WHERE org_id = 'org3' AND from_id IN (SELECT id FROM seen))
  SELECT CAST(rank AS INTEGER) AS rank, {SHOWN} FROM limited WHERE rank <= 30""")
def edges_acl(t):
    return graph.list_edges_visible(t("fx_edges"), t("fx_nodes"), t.sql(NODE_FACTS), t("fx_sources"), t("fx_memberships"), "org3", "U3")


# Edges whose start the user of a question may see, first 30 of each.
SEEN_EDGES = f"""{MATCHED}, seen_edges AS (SELECT q.query_id, m.*, row_number() OVER (PARTITION BY q.query_id ORDER BY m.from_id, m.to_id, m.relationship) AS rank
  FROM fx_questions q JOIN matched m ON m.org_id = q.org_id JOIN ({NODE_FACTS}) nf ON nf.id = m.from_id LEFT JOIN fx_sources s ON s.id = nf.source_id
  WHERE s.channel_is_private = false OR s.channel_id IS NULL OR EXISTS (SELECT 1 FROM fx_memberships u WHERE u.org_id = q.org_id AND u.user_id = q.user_id AND u.channel_id = s.channel_id))"""


def edges_for(t, questions):
    return graph.list_edges_for(questions, t("fx_edges"), t("fx_nodes"), t.sql(NODE_FACTS), t("fx_sources"), t("fx_memberships"))


@query("J4 G3", f"WITH {SEEN_EDGES} SELECT query_id, CAST(rank AS INTEGER) AS rank, {SHOWN} FROM seen_edges WHERE rank <= 30")
def edges_acl_many(t):
    return edges_for(t, t("fx_questions"))


@query("G4", f"WITH {MATCHED} SELECT {SHOWN} FROM matched WHERE org_id = 'org2' AND (contains(from_name, 'NATION_1') OR contains(to_name, 'NATION_1')) ORDER BY from_id, to_id, relationship LIMIT 20")
def neighbourhood(t):
    return graph.neighbourhood(t("fx_edges"), t("fx_nodes"), "org2", "NATION_1")


# Customers come back with new text under old and new ids, some of them twice.
NODE_CHANGES = """SELECT o_orderkey AS seq, 4000000 + o_orderkey % 2000 AS entity_id, 'org' || (o_orderkey % 4) AS org_id, 'Person' AS entity_type, 'Buyer ' || o_orderkey AS name, 'Order of ' || o_totalprice AS content
  FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) AS o_totalprice FROM orders) o"""


@query("G1", f"""WITH c AS ({NODE_CHANGES}), l AS (SELECT entity_id, arg_min(org_id, seq) AS org_id, arg_min(entity_type, seq) AS entity_type, arg_min(name, seq) AS name, arg_max(content, seq) AS content FROM c GROUP BY entity_id)
  SELECT coalesce(n.entity_id, l.entity_id) AS entity_id, coalesce(n.org_id, l.org_id) AS org_id, coalesce(n.entity_type, l.entity_type) AS entity_type, coalesce(n.name, l.name) AS name, coalesce(l.content, n.content) AS content
  FROM fx_nodes n FULL JOIN l ON l.entity_id = n.entity_id""")
def node_upsert(t):
    return graph.upsert_nodes(t("fx_nodes"), t.sql(NODE_CHANGES))


OWN_CHANGES = NODE_CHANGES.replace("'org' || (o_orderkey % 4) AS org_id", "'org' || (o_orderkey % 2000 % 4) AS org_id")


@query("G1 S18", f"""WITH c AS ({OWN_CHANGES}), l AS (SELECT org_id, entity_id, arg_min(entity_type, seq) AS entity_type, arg_min(name, seq) AS name, arg_max(content, seq) AS content FROM c GROUP BY ALL)
  SELECT coalesce(n.entity_id, l.entity_id) AS entity_id, coalesce(n.org_id, l.org_id) AS org_id, coalesce(n.entity_type, l.entity_type) AS entity_type, coalesce(n.name, l.name) AS name, coalesce(l.content, n.content) AS content
  FROM fx_nodes n FULL JOIN l ON l.entity_id = n.entity_id AND l.org_id = n.org_id""")
def nodes_in_place(t):
    """Three batches of changes, the second given twice, to nodes kept by organisation."""
    nodes, changes = t("fx_nodes"), t.sql(OWN_CHANGES)
    table = parted.Parted(fresh_path(t.spark, "nodes"), nodes.schema, "entity_id").create(nodes)
    for batch in (0, 1, 1, 2):
        parted.upsert_nodes(table, f"batch-{batch}", changes.filter(F.col("entity_id") % 3 == batch))
    return table.read(t.spark)


EDGE_CHANGES = "SELECT 4000000 + o_custkey AS from_id, 3000000 + o_orderkey % 150 AS to_id, 'manages' AS relationship_type FROM orders"


@query("G2", f"""WITH c AS ({EDGE_CHANGES}) SELECT from_id, to_id, relationship_type FROM fx_edges UNION ALL SELECT from_id, to_id, relationship_type FROM c
  WHERE from_id IN (SELECT entity_id FROM fx_nodes) AND to_id IN (SELECT entity_id FROM fx_nodes)""")
def edge_append(t):
    return graph.append_edges(t("fx_edges"), t.sql(EDGE_CHANGES), t("fx_nodes"))


# --- context -----------------------------------------------------------------

HEADER = """'Business: ' || coalesce(business_name, 'None') || chr(10) || 'Industry: ' || coalesce(industry, 'None') || chr(10) || 'Core services: ' || coalesce(core_services, 'None') || chr(10)
  || 'What they don''t do: ' || coalesce(what_they_dont_do, 'None') || chr(10) || 'Team size: ' || coalesce(CAST(team_size AS VARCHAR), 'None')"""
LINE = "'[' || entity_type || '] ' || coalesce(name, '') || ': ' || content"
ASK_ORGS = "SELECT org_id FROM fx_profiles WHERE id > 0 UNION ALL SELECT DISTINCT 'lost' || n_regionkey FROM nation"
SNAPSHOT = f"""orgs AS ({ASK_ORGS}), fb AS (SELECT org_id, string_agg({LINE}, chr(10) ORDER BY entity_type, created_at DESC, id) AS facts FROM fx_entities WHERE superseded_at IS NULL GROUP BY org_id),
  snap AS (SELECT o.org_id, CAST(0 AS BIGINT) AS part, CASE WHEN p.org_id IS NULL THEN '{context.NO_PROFILE}' ELSE {HEADER} || chr(10) || chr(10) || '== Known facts ==' || chr(10) || coalesce(fb.facts, '{context.NO_FACTS}') END AS context
    FROM orgs o LEFT JOIN fx_profiles p ON p.org_id = o.org_id LEFT JOIN fb ON fb.org_id = o.org_id)"""


def snapshots(t):
    return context.snapshots(t.sql(ASK_ORGS), t("fx_profiles"), t("fx_entities"))


@query("C1", f"WITH {SNAPSHOT} SELECT * FROM snap")
def context_snapshot(t):
    return snapshots(t)


@query("T15 J10 C1", f"""WITH {SNAPSHOT}, f AS (SELECT s.*, CASE WHEN coalesce(p.briefing_focus, '') = '' THEN {sql_quote([requests.DEFAULT_FOCUS])} ELSE p.briefing_focus END AS focus FROM snap s LEFT JOIN fx_profiles p ON p.org_id = s.org_id)
  SELECT org_id || '/0' AS request_id, 'briefing' AS kind, org_id, 'fast' AS model_tier, {sql_fill('briefing', focus='focus', context='context')} AS text FROM f""")
def briefing_requests(t):
    return requests.briefing_requests(snapshots(t), t("fx_profiles"))


@query("J10", f"""SELECT org_id, CASE WHEN coalesce(briefing_focus, '') = '' THEN {sql_quote([requests.DEFAULT_FOCUS])} ELSE briefing_focus END AS focus FROM fx_profiles""")
def briefing_focus(t):
    return t("fx_profiles").select("org_id", X.or_else(F.col("briefing_focus"), requests.DEFAULT_FOCUS).alias("focus"))


def hit_facts(t, hits):
    return context.hits_with_facts(hits, t("fx_entities"))


FACT_BLOCK = f"fact_block AS (SELECT query_id, string_agg({LINE}, chr(10) ORDER BY rank) AS block FROM ranked WHERE rank <= 5 GROUP BY query_id)"


@query("C2 V4", f"WITH {MANY}, {FACT_BLOCK} SELECT q.query_id, coalesce(b.block, '{context.NO_HITS}') AS fact_block FROM fx_questions q LEFT JOIN fact_block b ON b.query_id = q.query_id")
def fact_block(t):
    return context.fact_blocks(t("fx_questions").select("query_id"), hit_facts(t, many(t)))


@query("C4 V3", f"WITH {MANY_ACL} SELECT query_id, CAST(rank AS INTEGER) AS rank, source_id, entity_type, name, permalink, source_type FROM ranked WHERE rank <= 5 AND source_id IS NOT NULL")
def citations(t):
    return context.citations(hit_facts(t, many_visible(t)), t("fx_sources"))


EDGE_LINE = "'[' || from_type || '] ' || from_name || ' —' || relationship || '→ [' || to_type || '] ' || to_name || ': ' || to_content"
EDGE_BLOCK = f"{LIMITED}, edge_block AS (SELECT org_id, string_agg({EDGE_LINE}, chr(10) ORDER BY rank) AS edge_block FROM limited WHERE rank <= 30 GROUP BY org_id)"


@query("C3 G3", f"WITH {EDGE_BLOCK} SELECT * FROM edge_block")
def relationship_block(t):
    return context.relationship_blocks(graph.list_edges(t("fx_edges"), t("fx_nodes")))


ASKS = " OR ".join(f"contains(lower(question), '{p}')" for p in X.RELATIONSHIP_PHRASES)
ANSWERS = f"""{MANY_ACL}, {FACT_BLOCK}, {SEEN_EDGES}, edge_block AS (SELECT query_id, string_agg({EDGE_LINE}, chr(10) ORDER BY rank) AS edge_block FROM seen_edges WHERE rank <= 30 GROUP BY query_id), ctx AS (SELECT q.query_id, q.org_id, q.question, coalesce({HEADER} || chr(10), '') AS profile,
    '== Verified Facts ==' || chr(10) || coalesce(b.block, '{context.NO_HITS}') || CASE WHEN {ASKS} THEN chr(10) || chr(10) || '== Entity Relationships ==' || chr(10) || coalesce(e.edge_block, '{context.NO_EDGES}') ELSE '' END AS memory
  FROM fx_questions q LEFT JOIN fact_block b ON b.query_id = q.query_id LEFT JOIN edge_block e ON e.query_id = q.query_id LEFT JOIN fx_profiles p ON p.org_id = q.org_id)"""


@query("C6 C2 C3 T6 V3", f"WITH {ANSWERS} SELECT * FROM ctx")
def answer_context(t):
    """From question to model request: visible facts, visible relationships where asked for, profile."""
    facts = context.fact_blocks(t("fx_questions").select("query_id"), hit_facts(t, many_visible(t)))
    asking = t("fx_questions").filter(X.asks_for_relationships(F.col("question")))
    rels = context.relationship_blocks(edges_for(t, asking), "query_id")
    return context.answer_contexts(t("fx_questions"), facts, rels, t("fx_profiles"))


@query("T15 C6", f"""WITH {ANSWERS} SELECT CAST(query_id AS VARCHAR) AS request_id, 'answer' AS kind, org_id, 'full' AS model_tier,
  {sql_fill('answer', profile='profile', memory='memory', question='question')} AS text FROM ctx""")
def answer_requests(t):
    return requests.answer_requests(answer_context(t))


TASK_BLOCK = f"{MANY}, {FACT_BLOCK}"


def task_blocks(t):
    """Facts nearest to each task, of its organisation; only tasks with some."""
    asked = t("fx_questions").select("query_id", "org_id", F.col("question").alias("content"))
    return context.fact_blocks(asked, hit_facts(t, many(t))).filter(F.col("fact_block") != context.NO_HITS)


@query("T15 V4", f"""WITH {TASK_BLOCK} SELECT CAST(q.query_id AS VARCHAR) AS request_id, 'draft' AS kind, q.org_id, 'full' AS model_tier,
  {sql_fill('draft', task='q.question', context='b.block')} AS text FROM fx_questions q JOIN fact_block b ON b.query_id = q.query_id WHERE q.task_type = 'draft'""")
def draft_requests(t):
    return requests.draft_requests(t("fx_questions"), task_blocks(t))


@query("T15 V4", f"""WITH {TASK_BLOCK} SELECT CAST(q.query_id AS VARCHAR) AS request_id, 'contradiction' AS kind, q.org_id, 'full' AS model_tier,
  {sql_fill('contradiction', content='q.question', context='b.block')} AS text FROM fx_questions q JOIN fact_block b ON b.query_id = q.query_id WHERE q.task_type = 'flag'""")
def contradiction_requests(t):
    """Tasks that ask whether their text goes against the memory."""
    flagged = t("fx_questions").filter("task_type = 'flag'").select("query_id")
    return requests.contradiction_requests(task_blocks(t).join(flagged, "query_id", "left_semi"))


@query("H4 V4 T13 L8", f"""WITH {MANY}, used AS (SELECT query_id, count(*) AS n FROM ranked WHERE rank <= 5 GROUP BY query_id), c AS ({CHECKS}), b AS ({BELIEFS}),
  g AS (SELECT DISTINCT org_id FROM fx_entities WHERE entity_type = 'Belief' AND superseded_at IS NULL),
  j AS (SELECT q.query_id, q.org_id, q.task_type, coalesce(used.n, 0) AS memory_used, CASE WHEN used.n IS NULL THEN {sql_quote([tasks.NO_MEMORY])} WHEN b.conflict AND g.org_id IS NOT NULL THEN 'Action blocked by Belief: ' || b.belief ELSE '' END AS block_reason,
      CASE q.task_type WHEN 'draft' THEN k.draft WHEN 'flag' THEN CASE WHEN c.contradiction THEN 'CONTRADICTION DETECTED: ' ELSE 'No contradiction found. ' END || coalesce(c.reason, '') ELSE {sql_quote([tasks.UNKNOWN_TASK])} END AS done
    FROM fx_questions q LEFT JOIN used ON used.query_id = q.query_id LEFT JOIN g ON g.org_id = q.org_id LEFT JOIN c ON c.id = q.query_id LEFT JOIN b ON b.id = q.query_id LEFT JOIN fx_checks k ON k.id = q.query_id)
  SELECT query_id, org_id, task_type, memory_used, block_reason <> '' AS blocked, block_reason, CASE WHEN block_reason <> '' THEN 'BLOCKED: ' || block_reason ELSE done END AS result FROM j""")
def task_gate(t):
    answers = t("fx_checks").withColumnRenamed("id", "query_id")
    return tasks.gate_tasks(
        t("fx_questions").select("query_id", "org_id", "task_type"), many(t), context.active(t("fx_entities")).filter("entity_type = 'Belief'"),
        replies.belief_verdicts(answers), replies.contradiction_verdicts(answers), answers.select("query_id", "draft"))
