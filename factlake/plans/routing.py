"""Queries of routing, storing and the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, held, ingest, live, replies, review, routing, search
from ..session import fresh_path
from .registry import query
from .replies import CHECKS, CRITIC, PARSED

QUEUE_ORGS = "SELECT 'org' || n_nationkey AS org_id, CAST(n_nationkey * 7 AS BIGINT) AS waiting FROM nation"


def routed_sql(threshold: float) -> str:
    return f"""SELECT *, CASE WHEN approved AND confidence_score >= {threshold} THEN 'approved' WHEN confidence_score >= 0.5 THEN 'pending' ELSE 'rejected' END AS route FROM fx_candidates"""


@query("R1", f"SELECT seq, route FROM ({routed_sql(0.7)})")
def route_live(t):
    return routing.route(t("fx_candidates")).select("seq", "route")


@query("R2", f"SELECT seq, route FROM ({routed_sql(0.8)})")
def route_backfill(t):
    return routing.route(t("fx_candidates"), routing.BACKFILL_THRESHOLD).select("seq", "route")


# Running sum over every earlier source, the plain form of the cap.
ADMITTED = """{routed}, per AS (SELECT org_id, source_id, count(*) FILTER (WHERE route = 'pending') AS pending FROM r GROUP BY ALL),
  q AS ({queue}),
  run AS (SELECT p.org_id, p.source_id, coalesce(q.waiting, 0) + coalesce(sum(p.pending) OVER (PARTITION BY p.org_id ORDER BY p.source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 20 AS admitted
    FROM per p LEFT JOIN q ON q.org_id = p.org_id)"""


@query("W2", f"WITH {ADMITTED.format(routed=f'r AS ({routed_sql(0.7)})', queue=QUEUE_ORGS)} SELECT r.seq, run.admitted FROM r JOIN run ON run.org_id = r.org_id AND run.source_id = r.source_id")
def queue_cap(t):
    routed = routing.route(t("fx_candidates"))
    cutoffs = routing.queue_cutoffs(routing.pending_per_source(routed), t.sql(QUEUE_ORGS))
    return routing.admit(routed, cutoffs).select("seq", "admitted")


@query("W2", f"""WITH {ADMITTED.format(routed=f'r AS ({routed_sql(0.7)})', queue=QUEUE_ORGS)}
  SELECT org_id, source_id, 'pipeline_paused' AS log_type, '{routing.PAUSED}' AS content FROM run WHERE NOT admitted""")
def pause_logs(t):
    routed = routing.route(t("fx_candidates"))
    cutoffs = routing.queue_cutoffs(routing.pending_per_source(routed), t.sql(QUEUE_ORGS))
    return routing.pause_logs(routing.admit(routed, cutoffs))


FIRST = f"""WITH r AS ({routed_sql(0.7)}), a AS (SELECT *, row_number() OVER (PARTITION BY org_id, entity_type, name ORDER BY seq) AS rn FROM r WHERE route = 'approved')
  SELECT seq, org_id, entity_type, name FROM a WHERE (rn = 1 OR coalesce(name, '') = '')"""
KNOWN = "EXISTS (SELECT 1 FROM fx_entities e WHERE e.status = 'active' AND e.org_id = a.org_id AND e.entity_type = a.entity_type AND e.name = a.name)"


def approved(t):
    return routing.route(t("fx_candidates")).filter("route = 'approved'")


@query("W1", FIRST)
def dedup_first(t):
    return routing.first_of_name(approved(t)).select("seq", "org_id", "entity_type", "name")


@query("J6", f"WITH r AS ({routed_sql(0.7)}) SELECT seq FROM r a WHERE route = 'approved' AND NOT {KNOWN}")
def existing_anti(t):
    return routing.not_stored_yet(approved(t), t("fx_entities")).select("seq")


@query("W1 J6", f"{FIRST} AND NOT {KNOWN}")
def new_entities(t):
    return routing.new_entities(approved(t), t("fx_entities")).select("seq", "org_id", "entity_type", "name")


# Every candidate of a source points at the next two of the same source.
CANDIDATE_EDGES = """SELECT a.source_id, a.name AS from_name, b.name AS to_name, CASE WHEN a.seq % 2 = 0 THEN 'owns' END AS relationship_type
  FROM fx_candidates a JOIN fx_candidates b ON b.source_id = a.source_id AND b.seq - a.seq BETWEEN 1 AND 2 WHERE a.name IS NOT NULL"""
RESOLVED = f"""e AS ({CANDIDATE_EDGES}), stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY org_id, entity_type, name ORDER BY seq) AS rn FROM appr) a WHERE rn = 1 AND name <> '' AND NOT {KNOWN}),
  ids AS (SELECT org_id, entity_type, name, min(id) AS id FROM (SELECT org_id, entity_type, name, id FROM fx_entities WHERE status = 'active' AND name <> ''
    UNION ALL SELECT org_id, entity_type, name, 1000000 + seq FROM stored) GROUP BY ALL),
  last AS (SELECT source_id, name, arg_max(org_id, seq) AS org_id, arg_max(entity_type, seq) AS entity_type FROM appr WHERE name <> '' GROUP BY ALL),
  ends AS (SELECT l.source_id, l.name, l.org_id, i.id FROM last l JOIN ids i ON i.org_id = l.org_id AND i.entity_type = l.entity_type AND i.name = l.name),
  linked AS (SELECT f.org_id, e.source_id, f.id AS from_id, t.id AS to_id, coalesce(e.relationship_type, 'related_to') AS relationship_type
    FROM e JOIN ends f ON f.source_id = e.source_id AND f.name = e.from_name JOIN ends t ON t.source_id = e.source_id AND t.name = e.to_name)"""


@query("J5", f"WITH r AS ({routed_sql(0.1)}), appr AS (SELECT * FROM r WHERE route = 'approved'), {RESOLVED} SELECT * FROM linked")
def resolve_edges(t):
    # A low threshold, so that several candidates of a source are approved.
    passed = routing.route(t("fx_candidates"), 0.1).filter("route = 'approved'")
    stored = routing.new_entities(passed, t("fx_entities")).withColumn("id", F.lit(1000000) + F.col("seq"))
    return routing.resolve_edges(t.sql(CANDIDATE_EDGES), passed, stored, t("fx_entities"))


COUNTS = """count(*) AS proposed, count(*) FILTER (WHERE route = 'approved') AS approved, count(*) FILTER (WHERE route = 'rejected') AS rejected, count(*) FILTER (WHERE route = 'pending') AS pending"""


@query("A7", f"WITH r AS ({routed_sql(0.7)}) SELECT source_id, {COUNTS} FROM r GROUP BY source_id")
def run_counters(t):
    return routing.run_counters(routing.route(t("fx_candidates")), "source_id")


@query("A7", f"WITH r AS ({routed_sql(0.7)}) SELECT org_id, {COUNTS} FROM r GROUP BY org_id")
def org_counters(t):
    return routing.run_counters(routing.route(t("fx_candidates")), "org_id")


@query("S18", f"""WITH r AS ({routed_sql(0.7)}) SELECT org_id, source_id, seq, 'rejected_entity' AS log_type,
  'REJECTED: ' || coalesce(name, 'None') || ' — ' || coalesce(content, 'None') || ' — Reason: ' || coalesce(critic_reason, 'None') AS content FROM r WHERE route = 'rejected'""")
def rejection_logs(t):
    return routing.rejection_logs(routing.route(t("fx_candidates")).filter("route = 'rejected'"))


STORE = f"""WITH {ADMITTED.format(routed=f'r AS ({routed_sql(0.7)})', queue=QUEUE_ORGS)},
  ok AS (SELECT r.* FROM r JOIN run ON run.org_id = r.org_id AND run.source_id = r.source_id WHERE run.admitted), appr AS (SELECT * FROM ok WHERE route = 'approved'),
  a AS (SELECT *, row_number() OVER (PARTITION BY org_id, entity_type, name ORDER BY seq) AS rn FROM appr), {RESOLVED}
  SELECT 'entity' AS sink, org_id, source_id, 1000000 + seq AS key, content FROM a WHERE (rn = 1 OR coalesce(name, '') = '') AND NOT {KNOWN}
  UNION ALL SELECT 'node', org_id, 1000000 + seq, 1000000 + seq, content FROM a WHERE (rn = 1 OR coalesce(name, '') = '') AND NOT {KNOWN}
  UNION ALL SELECT 'edge', org_id, from_id, to_id, relationship_type FROM linked
  UNION ALL SELECT 'pending', org_id, source_id, seq, content FROM ok WHERE route = 'pending'
  UNION ALL SELECT 'log', org_id, source_id, seq, 'REJECTED: ' || coalesce(name, 'None') || ' — ' || coalesce(content, 'None') || ' — Reason: ' || coalesce(critic_reason, 'None') FROM ok WHERE route = 'rejected'
  UNION ALL SELECT 'held', r.org_id, r.source_id, r.seq, r.content FROM r JOIN run ON run.org_id = r.org_id AND run.source_id = r.source_id WHERE NOT run.admitted
  UNION ALL SELECT 'log', org_id, source_id, NULL, '{routing.PAUSED}' FROM run WHERE NOT admitted"""


@query("S18 R1 W1 W2 J5 J6", STORE)
def ingest_batch(t):
    """One live batch from scored candidates to every sink."""
    sinks = ingest.store_batch(t("fx_candidates"), t.sql(CANDIDATE_EDGES), t("fx_entities"), t.sql(QUEUE_ORGS), id_base=1000000,
                               keep=ingest.keep_under(fresh_path(t.spark, "ingest")))
    return ingest.as_rows(sinks)


@query("S18 R2 W1 J6", f"""WITH r AS ({routed_sql(0.8)}), a AS (SELECT *, row_number() OVER (PARTITION BY org_id, entity_type, name ORDER BY seq) AS rn FROM r WHERE route = 'approved')
  SELECT 'entity' AS sink, org_id, source_id, 1000000 + seq AS key, content FROM a WHERE (rn = 1 OR coalesce(name, '') = '') AND NOT {KNOWN}
  UNION ALL SELECT 'node', org_id, 1000000 + seq, 1000000 + seq, content FROM a WHERE (rn = 1 OR coalesce(name, '') = '') AND NOT {KNOWN}
  UNION ALL SELECT 'pending', org_id, source_id, seq, content FROM r WHERE route = 'pending'
  UNION ALL SELECT 'log', org_id, source_id, seq, 'REJECTED: ' || coalesce(name, 'None') || ' — ' || coalesce(content, 'None') FROM r WHERE route = 'rejected'""")
def backfill_batch(t):
    """One backfill batch: higher threshold, no queue cap, no edges."""
    return ingest.as_rows(ingest.store_backfill(t("fx_candidates"), t("fx_entities"), id_base=1000000))


LIVE = f"""{PARSED}, c AS ({CRITIC}),
  items AS (SELECT source_id, unnest(CAST(json_extract(obj, '$.entities') AS JSON[])) AS item, generate_subscripts(CAST(json_extract(obj, '$.entities') AS JSON[]), 1) - 1 AS pos FROM o WHERE json_type(obj, '$.entities') = 'ARRAY'),
  cand AS (SELECT CAST('0x' || substr(md5(s.org_id || '/' || i.source_id || '/' || i.pos), 1, 15) AS BIGINT) AS seq, s.org_id, i.source_id, i.item->>'$.entity_type' AS entity_type, i.item->>'$.name' AS name, i.item->>'$.content' AS content, c.approved, c.confidence_score, c.critic_reason
    FROM items i JOIN fx_sources s ON s.id = i.source_id JOIN c ON c.seq = i.source_id),
  links AS (SELECT source_id, unnest(CAST(json_extract(obj, '$.relationships') AS JSON[])) AS item FROM o WHERE json_type(obj, '$.relationships') = 'ARRAY'),
  r AS (SELECT *, CASE WHEN approved AND confidence_score >= 0.7 THEN 'approved' WHEN confidence_score >= 0.5 THEN 'pending' ELSE 'rejected' END AS route FROM cand),
  per AS (SELECT org_id, source_id, count(*) FILTER (WHERE route = 'pending') AS pending FROM r GROUP BY ALL),
  run AS (SELECT org_id, source_id, coalesce(sum(pending) OVER (PARTITION BY org_id ORDER BY source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 20 AS admitted FROM per),
  ok AS (SELECT r.* FROM r JOIN run ON run.org_id = r.org_id AND run.source_id = r.source_id WHERE run.admitted), appr AS (SELECT * FROM ok WHERE route = 'approved')
  SELECT 'entity' AS sink, org_id, source_id, 1000000000 + seq AS key, content FROM appr
  UNION ALL SELECT 'node', org_id, 1000000000 + seq, 1000000000 + seq, content FROM appr
  UNION ALL SELECT 'edge', f.org_id, 1000000000 + f.seq, 1000000000 + t.seq, l.item->>'$.relationship_type' FROM links l
    JOIN appr f ON f.source_id = l.source_id AND f.name = l.item->>'$.from_name' JOIN appr t ON t.source_id = l.source_id AND t.name = l.item->>'$.to_name'
  UNION ALL SELECT 'pending', org_id, source_id, seq, content FROM ok WHERE route = 'pending'
  UNION ALL SELECT 'log', org_id, source_id, seq, 'REJECTED: ' || coalesce(name, 'None') || ' — ' || coalesce(content, 'None') || ' — Reason: ' || coalesce(critic_reason, 'None') FROM ok WHERE route = 'rejected'
  UNION ALL SELECT 'held', r.org_id, r.source_id, r.seq, r.content FROM r JOIN run ON run.org_id = r.org_id AND run.source_id = r.source_id WHERE NOT run.admitted
  UNION ALL SELECT 'log', org_id, source_id, NULL, '{routing.PAUSED}' FROM run WHERE NOT admitted"""


@query("T10 T12 R1 W1 W2 J5 J6 S18", LIVE)
def live_ingest(t):
    """From extraction and critic replies to every sink; names in the replies are unique."""
    found = t("fx_replies").join(t("fx_sources").select(F.col("id").alias("source_id"), "org_id"), "source_id")
    candidates, _ = live.proposals(found)
    # The critic answered once per source here, for all of its candidates.
    verdicts = candidates.select("org_id", "seq", "source_id").join(t("fx_critic").withColumnRenamed("seq", "source_id"), "source_id").select("org_id", "seq", "reply")
    queue = t.spark.createDataFrame([], "org_id string, waiting bigint")
    sinks = live.store_replies(found, verdicts, t("fx_entities"), queue, id_base=1000000000,
                               keep=ingest.keep_under(fresh_path(t.spark, "live")))
    return ingest.as_rows(sinks)


# Reviews of the same organisations, each taking a few items out of the queue, some none.
REVIEWS = "SELECT 'org' || (user_id % 4) AS org_id, event_id AS review_no, CAST(event_id % 3 AS BIGINT) AS taken FROM events"


@query("W2", f"""WITH {ADMITTED.format(routed=f'r AS ({routed_sql(0.7)})', queue=QUEUE_ORGS)},
  waits AS (SELECT p.* FROM per p JOIN run USING (org_id, source_id) WHERE NOT run.admitted),
  now AS (SELECT run.org_id, coalesce(max(q.waiting), 0) + sum(CASE WHEN run.admitted THEN per.pending ELSE 0 END) AS waiting FROM run JOIN per USING (org_id, source_id) LEFT JOIN q ON q.org_id = run.org_id GROUP BY run.org_id),
  needs AS (SELECT w.org_id, w.source_id, w.pending, greatest(0, n.waiting - 19 + coalesce(sum(w.pending) OVER (PARTITION BY w.org_id ORDER BY w.source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS needs
    FROM waits w JOIN now n ON n.org_id = w.org_id),
  taken AS (SELECT org_id, review_no, sum(taken) OVER (PARTITION BY org_id ORDER BY review_no) AS total FROM ({REVIEWS}) WHERE taken > 0)
  SELECT n.org_id, n.source_id, n.pending, CASE WHEN needs = 0 THEN 0 ELSE t.review_no END AS released_by
  FROM needs n ASOF LEFT JOIN taken t ON n.org_id = t.org_id AND n.needs <= t.total""")
def held_replay(t):
    """Which review lets each held source in."""
    routed = routing.route(t("fx_candidates"))
    queue = t.sql(QUEUE_ORGS)
    flagged = routing.admit(routed, routing.queue_cutoffs(routing.pending_per_source(routed), queue))
    added = flagged.filter("admitted AND route = 'pending'").groupBy("org_id").agg(F.count("*").alias("waiting"))
    now = queue.unionByName(added)
    return held.released(flagged.filter("NOT admitted"), now, t.sql(REVIEWS))


# --- review ------------------------------------------------------------------

ASKED = "SELECT doc_id AS id, 'user ' || quality AS approved_by FROM labels"


@query("M2", f"""WITH q AS ({ASKED}) SELECT p.id AS pending_id, p.org_id, p.entity_type, p.name, p.content, p.source_id, q.approved_by, 'active' AS status FROM fx_pending p JOIN q ON q.id = p.id""")
def approve(t):
    return review.approve(t("fx_pending"), t.sql(ASKED))[0]


@query("M2", "SELECT id, org_id, review_type FROM fx_pending p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.id)")
def approve_remaining(t):
    return review.approve(t("fx_pending"), t.sql(ASKED))[1].select("id", "org_id", "review_type")


@query("M3", "SELECT id, org_id FROM fx_pending p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.id)")
def reject(t):
    return review.reject(t("fx_pending"), t.sql(ASKED))[0].select("id", "org_id")


@query("M3", "SELECT doc_id AS id, 'Pending entity not found.' AS error FROM labels l WHERE NOT EXISTS (SELECT 1 FROM fx_pending p WHERE p.id = l.doc_id)")
def reject_unknown(t):
    return review.reject(t("fx_pending"), t.sql(ASKED))[1]


ORGS = "SELECT org_id FROM fx_profiles WHERE id <> 1"


@query("M4", f"SELECT p.id AS pending_id, p.org_id, entity_type, name, content, source_id, 'bulk' AS approved_by, 'active' AS status FROM fx_pending p WHERE p.org_id IN ({ORGS})")
def bulk_approve(t):
    return review.bulk_approve(t("fx_pending"), t.sql(ORGS))[0]


@query("M4", f"""WITH o AS ({ORGS}), c AS (SELECT org_id, count(*) AS n FROM fx_pending GROUP BY org_id) SELECT o.org_id, coalesce(n, 0) AS items,
  coalesce(n, 0) || ' items rejected and removed from queue.' AS message FROM o LEFT JOIN c ON c.org_id = o.org_id""")
def bulk_reject(t):
    return review.bulk_reject(t("fx_pending"), t.sql(ORGS))[1]


@query("M4", f"SELECT id, org_id FROM fx_pending WHERE org_id NOT IN ({ORGS})")
def bulk_remaining(t):
    return review.bulk_reject(t("fx_pending"), t.sql(ORGS))[0].select("id", "org_id")


# --- contradictions ----------------------------------------------------------

NEAR_EARLIER = """act AS (SELECT * FROM fx_entities WHERE superseded_at IS NULL AND embedding IS NOT NULL),
  pairs AS (SELECT q.id AS query_id, f.id, f.entity_type, f.name, f.content, row_number() OVER (PARTITION BY q.id
      ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], f.embedding::DOUBLE[]), 9), f.id) AS rank
    FROM act q JOIN act f ON f.org_id = q.org_id AND f.id < q.id),
  near AS (SELECT query_id, to_json(list(struct_pack(entity_type := entity_type, name := coalesce(name, ''), content := content) ORDER BY rank)) AS neighbours FROM pairs WHERE rank <= 5 GROUP BY query_id)"""


@query("C5 V4 T13", f"""WITH {NEAR_EARLIER}, v AS ({CHECKS})
  SELECT e.id, e.org_id, e.source_id, e.entity_type, e.name, 'NEW: ' || e.content || chr(10) || chr(10) || 'CONFLICTS WITH: ' || n.neighbours || chr(10) || chr(10) || 'REASON: ' || coalesce(v.reason, 'None') AS content,
    coalesce(v.reason, 'Contradiction detected.') AS critic_reason, 0.5::DOUBLE AS confidence_score, 'contradiction' AS review_type
  FROM act e JOIN near n ON n.query_id = e.id JOIN v ON v.id = e.id WHERE v.contradiction""")
def contradiction_notes(t):
    """Each active fact as a new one, checked against the facts stored before it."""
    facts = search.searchable(t("fx_entities"))
    asked = facts.select("org_id", F.col("id").alias("query_id"), F.col("embedding").alias("vector"), F.col("id").alias("seq"))
    hits = search.top_k_many(asked, facts.withColumn("seq", F.col("id")), ["org_id"], 5, "seq", "seq")
    verdicts = replies.contradiction_verdicts(t("fx_checks").select("id", "reply"))
    return context.contradiction_notes(facts, context.hits_with_facts(hits, facts), verdicts)


LIVE_NEAR = f"""WITH r AS ({routed_sql(0.7)}), a AS (SELECT *, row_number() OVER (PARTITION BY org_id, entity_type, name ORDER BY seq) AS rn FROM r WHERE route = 'approved'),
  fresh AS (SELECT 1000000000 + a.seq AS id, a.seq, a.org_id, a.source_id, a.entity_type, a.name, a.content, v.embedding FROM a JOIN embeddings v ON v.vec_id = a.seq WHERE (rn = 1 OR coalesce(name, '') = '') AND NOT {KNOWN}),
  pool AS (SELECT id, org_id, entity_type, name, content, embedding, -1 AS seq FROM fx_entities WHERE superseded_at IS NULL AND embedding IS NOT NULL
    UNION ALL SELECT id, org_id, entity_type, name, content, embedding, seq FROM fresh),
  pairs AS (SELECT q.id AS query_id, f.entity_type, f.name, f.content, row_number() OVER (PARTITION BY q.id
      ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], f.embedding::DOUBLE[]), 9), f.id) AS rank
    FROM fresh q JOIN pool f ON f.org_id = q.org_id AND f.seq < q.seq),
  near AS (SELECT query_id, to_json(list(struct_pack(entity_type := entity_type, name := coalesce(name, ''), content := content) ORDER BY rank)) AS neighbours FROM pairs WHERE rank <= 5 GROUP BY query_id)"""


@query("C5 V4 T13 W1 S18", f"""{LIVE_NEAR}, v AS ({CHECKS})
  SELECT e.id, e.org_id, e.source_id, e.entity_type, e.name, 'NEW: ' || e.content || chr(10) || chr(10) || 'CONFLICTS WITH: ' || n.neighbours || chr(10) || chr(10) || 'REASON: ' || coalesce(v.reason, 'None') AS content,
    coalesce(v.reason, 'Contradiction detected.') AS critic_reason, 0.5::DOUBLE AS confidence_score, 'contradiction' AS review_type
  FROM fresh e JOIN near n ON n.query_id = e.id JOIN v ON v.id = e.seq WHERE v.contradiction""")
def live_contradictions(t):
    """Only the facts that a batch stores are checked, against those stored before them."""
    vectors = t("embeddings").select(F.col("vec_id").alias("seq"), "embedding")

    def check(asked):
        replies_to = t("fx_checks").select((F.lit(1000000000) + F.col("id")).alias("query_id"), "reply")
        return asked.select("query_id").join(replies_to, "query_id")

    return live.contradictions(t("fx_candidates"), t("fx_entities"), lambda facts: facts.join(vectors, "seq"), check, id_base=1000000000,
                               keep=ingest.keep_under(fresh_path(t.spark, "contradictions")))
