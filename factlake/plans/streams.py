"""Streaming jobs run over the tables until they are drained, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import fresh_path
from ..streaming import heartbeats, jobs
from .registry import StreamTables, query
from .sources import EXPORT_OLDEST, IMPORT, export_now
from .state import BEATS
from .text import BUNDLE, SKIP, sql_clean


def drained(stream) -> None:
    stream.awaitTermination()


def ingested(hours: float) -> str:
    return f"""WITH found AS ({IMPORT}{EXPORT_OLDEST.format(hours=hours)}),
  kept AS (SELECT msg_id, org_id, channel_id, thread_ts, channel_is_private, user_id, subtype, ts, {sql_clean('content')} AS content FROM found WHERE ({SKIP}) IS NULL),
  bundled AS ({BUNDLE.format(src='kept')}) SELECT msg_id AS id, org_id, channel_id, content AS raw_content, 'slack_daily' AS source_type FROM bundled"""


def run_ingest(t, hours: float, unique: bool = False, repeat: bool = False):
    out = fresh_path(t.spark, "ingest")
    raw = StreamTables(t.spark, t.sf_dir)("fx_export").drop("msg_id")
    drained(jobs.ingest_messages(
        raw.unionByName(raw) if repeat else raw, t("fx_channels"), t("fx_profiles"), f"{out}/tables", f"{out}/checkpoint",
        hours_back=hours, now=export_now, unique=unique))
    return jobs.read_table(t.spark, f"{out}/tables", "sources").select("id", "org_id", "channel_id", "raw_content", "source_type")


@query("ST1", ingested(0.5 * 960))
def stream_micro_batch(t):
    return run_ingest(t, 0.5 * 960)


@query("ST2", ingested(24 * 30))
def stream_daily(t):
    return run_ingest(t, 24 * 30)


@query("ST6", ingested(24 * 30))
def stream_unique(t):
    """The export delivered twice, as overlapping look-backs do, stored once."""
    return run_ingest(t, 24 * 30, unique=True, repeat=True)


HISTORY = """SELECT doc_id AS id, 'org' || (doc_id % 4) AS org_id, 'slack_history' AS source_type, text AS raw_content,
  CASE WHEN doc_id % 3 > 0 THEN n_chars END AS processed_at FROM documents"""


@query("ST3", f"""WITH s AS ({HISTORY}), e AS (SELECT id, org_id, 'Client' AS entity_type, md5(raw_content) AS name, raw_content AS content, (id * 37) % 101 / 100.0::DOUBLE AS score FROM s WHERE processed_at IS NULL),
  f AS (SELECT *, row_number() OVER (PARTITION BY org_id, name ORDER BY id) AS rn FROM e WHERE score >= 0.8)
  SELECT CAST('0x' || substr(md5(org_id || '/' || id || '/0'), 1, 15) AS BIGINT) AS id, org_id, name, content, id AS source_id FROM f WHERE (rn = 1 OR name = '')
    AND NOT EXISTS (SELECT 1 FROM fx_entities x WHERE x.status = 'active' AND x.org_id = f.org_id AND x.entity_type = 'Client' AND x.name = f.name)""")
def stream_backfill(t):
    """Backlog drained with a stand-in model: each text is a fact, named by its hash, so copies are stored once."""
    out = fresh_path(t.spark, "backfill")

    def extract(asked):
        packed = asked.select("request_id", "org_id", "batch_no").join(
            jobs.read_table(t.spark, f"{out}/tables", "packed"), ["org_id", "batch_no"])
        item = F.struct(F.col("idx").alias("message_index"), F.array(F.struct(
            F.lit("Client").alias("entity_type"), F.md5("raw_content").alias("name"),
            F.col("raw_content").alias("content"))).alias("entities"))
        return packed.groupBy("request_id").agg(F.to_json(F.collect_list(item)).alias("reply"))

    def criticise(candidates):
        score = (F.col("source_id") * 37 % 101 / 100).cast("double")
        return candidates.select("org_id", "seq", F.to_json(F.struct(F.lit(True).alias("approved"), score.alias("confidence_score"))).alias("reply"))

    sources = StreamTables(t.spark, t.sf_dir).sql(HISTORY)
    drained(jobs.drain_backfill(sources, t("fx_entities"), f"{out}/tables", f"{out}/checkpoint", extract=extract, criticise=criticise))
    return jobs.read_table(t.spark, f"{out}/tables", "entities").select("id", "org_id", "name", "content", "source_id")


@query("ST3", f"""WITH s AS ({HISTORY}) SELECT id, org_id, CASE org_id WHEN 'org2' THEN 'given up' ELSE 'answered' END AS state,
  CAST(CASE WHEN org_id IN ('org1', 'org2') THEN 2 ELSE 1 END AS BIGINT) AS tries FROM s WHERE processed_at IS NULL""")
def stream_backlog(t):
    """Three runs, the later ones without new sources: one organisation is never answered, one only when asked again."""
    out = fresh_path(t.spark, "backlog")
    silent = {0: ["org1", "org2"], 1: ["org2"], 2: ["org2"]}

    def extract(asked):
        return asked.filter(~F.col("org_id").isin(silent[run])).select("request_id", F.lit("[]").alias("reply"))

    def criticise(candidates):
        return candidates.select("org_id", "seq", F.lit("{}").alias("reply"))

    for run in silent:
        sources = StreamTables(t.spark, t.sf_dir).sql(HISTORY)
        drained(jobs.drain_backfill(sources, t("fx_entities"), f"{out}/tables", f"{out}/checkpoint", extract=extract, criticise=criticise, tries=2, backoff=0))
    tries = jobs.read_table(t.spark, f"{out}/tables", "packed").groupBy("org_id", "id").agg(F.count("*").alias("tries"))
    ended = jobs.read_table(t.spark, f"{out}/tables", "processed").select("org_id", "id", F.lit("answered").alias("state")).unionByName(
        jobs.read_table(t.spark, f"{out}/tables", "dead_letters").select("org_id", "id", F.lit("given up").alias("state")))
    return tries.join(ended, ["org_id", "id"], "left").select("id", "org_id", "state", "tries")


@query("ST4", f"WITH {BEATS} SELECT process_name, last_beat_at, last_status, last_error FROM latest")
def stream_heartbeat(t):
    out = fresh_path(t.spark, "beats")
    drained(heartbeats.watch(StreamTables(t.spark, t.sf_dir)("fx_beats"), f"{out}/tables", f"{out}/checkpoint"))
    rows = jobs.read_table(t.spark, f"{out}/tables", "beats")
    last = F.max_by(F.struct("last_beat_at", "last_status", "last_error"), F.struct("batch_id", "last_beat_at"))
    return rows.groupBy("process_name").agg(last.alias("b")).select(
        "process_name", F.col("b.last_beat_at").cast("timestamp_ntz").alias("last_beat_at"), "b.last_status", "b.last_error")


@query("ST5", """SELECT org_id, month, CAST(sum(tokens) AS BIGINT) AS tokens_used, CAST(500000 AS BIGINT) AS budget_limit, sum(tokens) >= 500000 AS over_budget FROM fx_usage GROUP BY ALL""")
def stream_token_meter(t):
    out = fresh_path(t.spark, "usage")
    drained(jobs.meter_tokens(StreamTables(t.spark, t.sf_dir)("fx_usage"), f"{out}/tables", f"{out}/checkpoint"))
    return jobs.current_usage(t.spark, f"{out}/tables")
