"""Queries of listings, counts, monitoring and mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import age_text
from ..operators import evals, memory, metering, monitor, parted, requests
from ..session import fresh_path
from ..sources import chat
from .registry import query
from .sources import now
from .text import sql_strip

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


# --- listings ----------------------------------------------------------------

@query("L1", "SELECT id, org_id, entity_type, name, content FROM fx_entities WHERE superseded_at IS NULL")
def active_facts(t):
    return memory.active_facts(t("fx_entities")).select("id", "org_id", "entity_type", "name", "content")


@query("L2", "SELECT id, org_id, entity_type, name, content, status, created_at FROM fx_entities WHERE status = 'superseded'")
def by_status(t):
    return memory.by_status(t("fx_entities"), "superseded").select("id", "org_id", "entity_type", "name", "content", "status", "created_at")


@query("L3", "SELECT id, entity_type, name, content, created_at FROM fx_entities WHERE org_id = 'org1' AND superseded_at IS NULL ORDER BY created_at DESC, id LIMIT 20 OFFSET 20")
def list_page(t):
    return memory.page(t("fx_entities"), "org1", offset=20).select("id", "entity_type", "name", "content", "created_at")


@query("L3", "SELECT count(*) AS total FROM fx_entities WHERE org_id = 'org1' AND superseded_at IS NULL AND entity_type = 'Project'")
def list_total(t):
    return memory.page_total(t("fx_entities"), "org1", "Project")


@query("L4", "SELECT id, entity_type, name, content, critic_reason, confidence_score, review_type, created_at FROM fx_pending WHERE org_id = 'org0' AND review_type = 'contradiction'")
def pending_queue(t):
    return memory.review_queue(t("fx_pending"), "org0", "contradiction").select(
        "id", "entity_type", "name", "content", "critic_reason", "confidence_score", "review_type", "created_at")


@query("L5", """SELECT id, org_id, content, created_at, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY created_at DESC, id) AS rn
  FROM fx_logs WHERE log_type = 'contradiction_flag') WHERE rn <= 20""")
def log_top(t):
    return memory.latest_logs(t("fx_logs"), "contradiction_flag").select("id", "org_id", "content", "created_at", "rank")


@query("L6 W3", f"""WITH b AS (SELECT org_id, first(content ORDER BY created_at DESC, id) AS content, max(created_at) AS created_at FROM fx_logs WHERE log_type = 'daily_briefing' GROUP BY org_id)
  SELECT p.org_id, b.content AS briefing, b.created_at, CASE WHEN b.org_id IS NULL THEN '{memory.NO_BRIEFING}' END AS message FROM fx_profiles p LEFT JOIN b ON b.org_id = p.org_id""")
def latest_briefing(t):
    return memory.latest_briefings(t("fx_profiles"), t("fx_logs"))


@query("L7", "SELECT id, org_id, question, expected_answer FROM fx_golden WHERE org_id = 'org2'")
def eval_listing(t):
    return t("fx_golden").filter("org_id = 'org2'").select("id", "org_id", "question", "expected_answer")


@query("L8", "SELECT id, org_id, entity_type, content FROM fx_entities WHERE superseded_at IS NULL AND entity_type IN ('Belief', 'Decision')")
def beliefs(t):
    facts = t("fx_entities")
    return memory.of_type(facts, "Belief").unionByName(memory.of_type(facts, "Decision")).select("id", "org_id", "entity_type", "content")


@query("L9", "SELECT org_id, entity_type, count(*) > 0 AS has_memory FROM fx_entities WHERE superseded_at IS NULL GROUP BY ALL")
def has_memory(t):
    return memory.has_memory(t("fx_entities"))


@query("L11", f"SELECT id, org_id, created_at FROM fx_sources WHERE created_at >= {NOW} - INTERVAL 720 HOUR")
def look_back(t):
    return memory.since(t("fx_sources"), "created_at", now(), 720).select("id", "org_id", "created_at")


@query("W3", """SELECT org_id, log_type, id, content FROM (SELECT *, row_number() OVER (PARTITION BY org_id, log_type ORDER BY created_at DESC, id) AS rn FROM fx_logs) WHERE rn = 1""")
def latest_state(t):
    return memory.latest_per_key(t("fx_logs"), ["org_id", "log_type"], memory.newest()).select("org_id", "log_type", "id", "content")


# --- counts ------------------------------------------------------------------

@query("A1", "SELECT org_id, count(*) AS pending_count FROM fx_pending GROUP BY org_id")
def pending_counts(t):
    return metering.pending_counts(t("fx_pending"))


@query("A2", "SELECT org_id, count(*) AS total_memories FROM fx_entities WHERE superseded_at IS NULL GROUP BY org_id")
def fact_counts(t):
    return metering.fact_counts(t("fx_entities"))


@query("A3", """WITH c AS (SELECT org_id, count(*) AS n, count(processed_at) AS p FROM fx_sources WHERE source_type = 'slack_history' GROUP BY org_id)
  SELECT o.org_id, coalesce(n, 0) AS total_backfill_sources, coalesce(p, 0) AS processed, coalesce(n, 0) - coalesce(p, 0) AS remaining,
    CASE WHEN coalesce(n, 0) > 0 THEN round_even(p / n * 100, 1) ELSE 100.0::DOUBLE END AS percent_complete FROM fx_profiles o LEFT JOIN c ON c.org_id = o.org_id""")
def backfill_progress(t):
    return metering.backfill_progress(t("fx_profiles"), t("fx_sources"))


USAGE = "SELECT org_id, month, CAST(sum(tokens) AS BIGINT) AS tokens_used FROM fx_usage GROUP BY ALL"
STORED = "SELECT org_id, month, tokens_used, CAST(CASE org_id WHEN 'org1' THEN 1000000000 ELSE 500000 END AS BIGINT) AS budget_limit FROM ({usage}) u"


def stored_usage(t):
    limit = F.when(F.col("org_id") == "org1", 1000000000).otherwise(metering.BUDGET).cast("bigint")
    return metering.usage(t("fx_usage")).withColumn("budget_limit", limit)


@query("A4", USAGE)
def token_usage(t):
    return metering.usage(t("fx_usage"))


@query("A5", f"""WITH s AS ({STORED.format(usage=USAGE)}) SELECT o.org_id, coalesce(s.tokens_used >= s.budget_limit, false) AS over_budget
  FROM fx_profiles o LEFT JOIN s ON s.org_id = o.org_id AND s.month = '2024-01'""")
def budget(t):
    return metering.budget_state(t("fx_profiles"), stored_usage(t), "2024-01")


@query("A5 T15", f"""WITH s AS ({STORED.format(usage=USAGE)}) SELECT f.id, f.org_id FROM fx_sources f LEFT JOIN s ON s.org_id = f.org_id AND s.month = '2024-01' WHERE NOT coalesce(s.tokens_used >= s.budget_limit, false)""")
def within_budget(t):
    over = metering.budget_state(t("fx_profiles"), stored_usage(t), "2024-01")
    return requests.within_budget(t("fx_sources"), over).select("id", "org_id")


@query("A6", f"""WITH s AS ({STORED.format(usage=USAGE)}) SELECT o.org_id, '2024-01' AS month, coalesce(tokens_used, 0) AS tokens_used, coalesce(budget_limit, 500000) AS budget_limit,
  coalesce(tokens_used >= budget_limit, false) AS over_budget, CAST(floor(coalesce(tokens_used, 0) / coalesce(budget_limit, 500000) * 100 + 0.5) AS BIGINT) AS used_percent
  FROM fx_profiles o LEFT JOIN s ON s.org_id = o.org_id AND s.month = '2024-01'""")
def usage_summary(t):
    return metering.usage_summary(t("fx_profiles"), stored_usage(t), "2024-01")


OLD_USAGE = "SELECT 'org' || s_suppkey AS org_id, '2024-01' AS month, s_suppkey * 10 AS tokens_used, CAST(700000 AS BIGINT) AS budget_limit FROM supplier"


@query("M5", f"""WITH o AS ({OLD_USAGE}), x AS (SELECT * FROM o UNION ALL SELECT org_id, month, tokens_used, NULL FROM ({USAGE}))
  SELECT org_id, month, CAST(sum(tokens_used) AS BIGINT) AS tokens_used, coalesce(max(budget_limit), 500000) AS budget_limit FROM x GROUP BY ALL""")
def usage_upsert(t):
    return metering.add_usage(t.sql(OLD_USAGE), t("fx_usage"))


@query("A8 T14", """WITH c AS (SELECT org_id, count(*) AS n, count(*) FILTER (WHERE contains(upper(verdict), 'PASS')) AS p FROM fx_golden GROUP BY org_id),
  r AS (SELECT o.org_id, coalesce(n, 0) AS total, coalesce(p, 0) AS passed, CASE WHEN n > 0 THEN round_even(p / n * 100, 1) END AS pass_rate FROM fx_profiles o LEFT JOIN c ON c.org_id = o.org_id)
  SELECT *, 'Eval run: ' || passed || '/' || total || ' passed (' || format('{:.1f}', pass_rate) || '%). ' || CASE WHEN pass_rate < 80 THEN '⚠️ Below 80% threshold.' ELSE 'OK.' END AS log_line FROM r""")
def eval_pass_rate(t):
    return evals.pass_rates(t("fx_profiles"), evals.scored(t("fx_golden")))


@query("M10", f"""SELECT id, org_id, CASE WHEN contains(upper(verdict), 'PASS') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS last_score, 'Answer ' || id AS last_actual_answer, {NOW} AS last_run_at FROM fx_golden""")
def eval_writeback(t):
    results = evals.scored(t("fx_golden")).withColumn("actual", F.concat(F.lit("Answer "), F.col("id").cast("string")))
    return evals.write_back(t("fx_golden"), results, now()).select("id", "org_id", "last_score", "last_actual_answer", "last_run_at")


# --- monitoring --------------------------------------------------------------

REGISTRY = ", ".join(f"('{k}', {v})" for k, v in monitor.REGISTRY.items())
BEATS = """latest AS (SELECT process_name, max(beat_at) AS last_beat_at, first(status ORDER BY beat_at DESC, event_id DESC) AS last_status,
  first(error ORDER BY beat_at DESC, event_id DESC) AS last_error FROM fx_beats GROUP BY process_name)"""
CHECKED = f"""reg AS (SELECT * FROM (VALUES {REGISTRY}) v(process_name, interval_min)), {BEATS},
  late AS (SELECT r.process_name AS process, l.last_beat_at, coalesce(l.last_status, 'never_run') AS last_status, l.last_error, r.interval_min AS expected_interval_minutes,
      epoch_us({NOW}) - epoch_us(l.last_beat_at) - CAST(r.interval_min * 90000000.0 AS BIGINT) AS late FROM reg r LEFT JOIN latest l ON l.process_name = r.process_name),
  checked AS (SELECT process, last_beat_at, last_status, last_error, expected_interval_minutes, coalesce(late > 0, true) AS overdue, CASE WHEN coalesce(late > 0, true) THEN late // 60000000 END AS overdue_by_minutes FROM late)"""


def checked(t):
    return monitor.check_all(monitor.registry(t.spark), monitor.latest_beats(t("fx_beats")), now())


@query("H1 J8 W3", f"WITH {CHECKED} SELECT * FROM checked")
def overdue(t):
    return checked(t)


@query("H2", f"""WITH {CHECKED} SELECT process, 'OVERDUE: ' || process || ' | ' || CASE WHEN coalesce(overdue_by_minutes, 0) = 0 THEN 'never run' ELSE overdue_by_minutes || ' min past deadline' END || ' | expected every ' || expected_interval_minutes
  || ' min | last beat: ' || coalesce(strftime(last_beat_at, '%Y-%m-%dT%H:%M:%S.%f'), 'never') || ' | last status: ' || last_status || CASE WHEN coalesce(last_error, '') <> '' THEN ' | error: ' || last_error ELSE '' END AS alert FROM checked WHERE overdue""")
def alerts(t):
    return monitor.alert_lines(checked(t))


@query("A9", f"""WITH {CHECKED} SELECT CASE WHEN bool_or(overdue) THEN 'degraded' ELSE 'ok' END AS status, count(*) FILTER (WHERE NOT overdue) AS ok_processes, count(*) FILTER (WHERE overdue) AS overdue_processes FROM checked""")
def health(t):
    return monitor.health(checked(t))


@query("H3", f"""WITH s AS (SELECT event_id AS id, CAST(floor((epoch_us({NOW}) - epoch_us(CASE WHEN event_id % 50 > 0 THEN ts END)) / 1000000) AS BIGINT) AS s FROM events)
  SELECT id, CASE WHEN s IS NULL THEN 'Never' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS age FROM s""")
def relative_age(t):
    seen = F.when(F.col("event_id") % 50 > 0, F.col("ts"))
    return t("events").select(F.col("event_id").alias("id"), age_text(seen, now()).alias("age"))


# Beats of the first half of the month are stored, the rest arrives.
@query("M7", f"""WITH reg AS (SELECT * FROM (VALUES {REGISTRY}) v(process_name, interval_min)), {BEATS}
  SELECT l.process_name, last_beat_at, last_status, last_error, interval_min AS expected_interval_minutes FROM latest l JOIN reg r ON r.process_name = l.process_name""")
def heartbeat_upsert(t):
    beats, middle = t("fx_beats"), F.expr("timestamp_ntz'2024-01-16 00:00:00'")
    stored = monitor.latest_beats(beats.filter(F.col("beat_at") < middle))
    return monitor.apply_beats(stored, beats.filter(F.col("beat_at") >= middle), monitor.registry(t.spark))[0]


@query("M7", """SELECT DISTINCT event_type AS process_name, 'Unknown process ''' || event_type || '''.' AS error FROM events""")
def heartbeat_unknown(t):
    beats = t("fx_beats").drop("process_name").join(t("events").select("event_id", F.col("event_type").alias("process_name")), "event_id")
    stored = monitor.latest_beats(t("fx_beats"))
    return monitor.apply_beats(stored, beats, monitor.registry(t.spark))[1]


@query("A10 A1 A2", f"""WITH f AS (SELECT org_id, count(*) AS n FROM fx_entities WHERE superseded_at IS NULL GROUP BY org_id), q AS (SELECT org_id, count(*) AS n FROM fx_pending GROUP BY org_id)
  SELECT o.org_id, c.nationkey IS NOT NULL AS gmail_connected, (SELECT max(beat_at) FROM fx_beats WHERE process_name = 'micro_batch') AS last_sync_at, coalesce(f.n, 0) AS total_memories, coalesce(q.n, 0) AS pending_count
  FROM fx_profiles o LEFT JOIN (SELECT 'org' || n_nationkey AS org_id, n_nationkey AS nationkey FROM nation WHERE n_regionkey > 1) c ON c.org_id = o.org_id LEFT JOIN f ON f.org_id = o.org_id LEFT JOIN q ON q.org_id = o.org_id""")
def org_status(t):
    links = t("nation").select(F.concat(F.lit("org"), F.col("n_nationkey").cast("string")).alias("org_id"),
                               F.when(F.col("n_regionkey") > 1, F.lit("token")).alias("access_token"))
    return metering.status_cards(t("fx_profiles"), t("fx_entities"), t("fx_pending"), monitor.latest_beats(t("fx_beats")), links)


# --- mutations ---------------------------------------------------------------

SUPERSEDED = """good AS (SELECT c.* FROM fx_supersede c WHERE EXISTS (SELECT 1 FROM fx_entities e WHERE e.org_id = c.org_id AND e.id = c.old_id) AND EXISTS (SELECT 1 FROM fx_entities e WHERE e.org_id = c.org_id AND e.id = c.new_id)),
  touch AS (SELECT old_id AS id, seq * 2 AS step, 'superseded' AS st, new_id AS by_id FROM good UNION ALL SELECT new_id, seq * 2 + 1, 'active', NULL FROM good),
  l AS (SELECT id, arg_max(st, step) AS st, arg_max(by_id, step) FILTER (WHERE st = 'superseded') AS by_id, bool_or(st = 'superseded') AS retired FROM touch GROUP BY id)"""


@query("M1", f"""WITH {SUPERSEDED} SELECT e.id, coalesce(l.st, e.status) AS status, CASE WHEN l.retired THEN {NOW} ELSE e.superseded_at END AS superseded_at, l.by_id AS superseded_by_id FROM fx_entities e LEFT JOIN l ON l.id = e.id""")
def supersede(t):
    table, _ = memory.supersede(t("fx_entities"), t("fx_supersede"), now())
    return table.select("id", "status", "superseded_at", "superseded_by_id")


@query("M1", f"""WITH {SUPERSEDED} SELECT c.seq, c.org_id, c.old_id, c.new_id, CASE WHEN g.seq IS NOT NULL THEN 'Entity ' || c.old_id || ' superseded by ' || c.new_id || '.' END AS message,
  CASE WHEN g.seq IS NULL THEN '{memory.NOT_FOUND}' END AS error FROM fx_supersede c LEFT JOIN good g ON g.seq = c.seq""")
def supersede_outcomes(t):
    return memory.supersede(t("fx_entities"), t("fx_supersede"), now())[1]


@query("M6", """SELECT DISTINCT m.org_id, m.channel_id, m.user_id FROM (SELECT 'org' || (o_custkey % 4) AS org_id, 'C' || (o_custkey % 8) AS channel_id, 'U' || (o_orderkey % 20) AS user_id FROM orders) m
  WHERE NOT EXISTS (SELECT 1 FROM fx_memberships x WHERE x.org_id = m.org_id AND x.channel_id = m.channel_id AND x.user_id = m.user_id)""")
def membership_upsert(t):
    found = t.sql("SELECT 'org' || (o_custkey % 4) AS org_id, 'C' || (o_custkey % 8) AS channel_id, 'U' || (o_orderkey % 20) AS user_id FROM orders")
    return chat.insert_or_ignore(found, t("fx_memberships"))


FOCUS = "SELECT 'org' || (n_nationkey * 5) AS org_id, '  Focus on ' || n_name || chr(9) AS briefing_focus FROM nation"


@query("M8", f"""WITH c AS ({FOCUS}) SELECT p.org_id, coalesce({sql_strip('c.briefing_focus')}, p.briefing_focus) AS briefing_focus FROM fx_profiles p LEFT JOIN c ON c.org_id = p.org_id""")
def profile_update(t):
    return memory.set_briefing_focus(t("fx_profiles"), t.sql(FOCUS))[0].select("org_id", "briefing_focus")


@query("M8", f"WITH c AS ({FOCUS}) SELECT org_id, 'Organisation not found.' AS error FROM c WHERE org_id NOT IN (SELECT org_id FROM fx_profiles)")
def profile_unknown(t):
    return memory.set_briefing_focus(t("fx_profiles"), t.sql(FOCUS))[1]


@query("M9", f"SELECT id, CASE WHEN id IN (SELECT doc_id FROM labels) THEN {NOW} ELSE processed_at END AS processed_at FROM fx_sources")
def mark_processed(t):
    done = t("labels").select(F.col("doc_id").alias("id"))
    return memory.mark_processed(t("fx_sources"), done, now()).select("id", "processed_at")


# --- the same in tables kept by organisation, each change in several batches ---

def kept(t, name: str, rows, key: str) -> parted.Parted:
    return parted.Parted(fresh_path(t.spark, name), rows.schema, key).create(rows)


@query("M1 S18", f"""WITH {SUPERSEDED} SELECT e.id, e.org_id, coalesce(l.st, e.status) AS status, CASE WHEN l.retired THEN {NOW} ELSE e.superseded_at END AS superseded_at, l.by_id AS superseded_by_id FROM fx_entities e LEFT JOIN l ON l.id = e.id""")
def supersede_in_place(t):
    facts = t("fx_entities").withColumn("superseded_by_id", F.lit(None).cast("bigint"))
    table, changes = kept(t, "facts", facts, "id"), t("fx_supersede")
    # Each organisation's changes come as a batch of its own.
    for org in ("org0", "org1", "org2", "org3"):
        parted.supersede(table, org, changes.filter(F.col("org_id") == org), now())
    return table.read(t.spark).select("id", "org_id", "status", "superseded_at", "superseded_by_id")


@query("M9 S18", f"SELECT id, org_id, CASE WHEN id IN (SELECT doc_id FROM labels) THEN {NOW} ELSE processed_at END AS processed_at FROM fx_sources")
def processed_in_place(t):
    table = kept(t, "sources", t("fx_sources"), "id")
    done = t("labels").select(F.concat(F.lit("org"), (F.col("doc_id") % 4).cast("string")).alias("org_id"), F.col("doc_id").alias("id"))
    for batch in range(2):
        parted.mark_processed(table, f"batch-{batch}", done.filter(F.col("id") % 2 == batch), now())
    return table.read(t.spark).select("id", "org_id", "processed_at")


NEW_ORGS = "SELECT c_custkey AS id, 'Supplier#' || lpad(CAST(c_custkey % 1200 AS STRING), 9, '0') AS business_name FROM customer"


@query("M11 J9", f"""WITH n AS ({NEW_ORGS}), m AS (SELECT *, row_number() OVER (PARTITION BY business_name ORDER BY id) = 1 AND business_name NOT IN (SELECT business_name FROM fx_profiles) AS accepted FROM n)
  SELECT id, business_name, accepted, CASE WHEN accepted THEN 'Organisation created successfully' ELSE 'Organisation already exists' END AS message FROM m""")
def create_org(t):
    return memory.create_orgs(t.sql(NEW_ORGS), t("fx_profiles"))


@query("M11", """SELECT id, org_id, question, expected_answer FROM fx_golden UNION ALL SELECT 100000000 + item_id, 'org' || (item_id % 4), 'What is item ' || item_id || '?', text FROM benchmark""")
def add_eval(t):
    new = t.sql("SELECT 100000000 + item_id AS id, 'org' || (item_id % 4) AS org_id, 'What is item ' || item_id || '?' AS question, text AS expected_answer FROM benchmark")
    return t("fx_golden").select("id", "org_id", "question", "expected_answer").unionByName(new)
