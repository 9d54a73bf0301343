"""Streams: restarts, repeats and timers."""

import datetime
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from factlake.streaming import heartbeats, jobs

EVENTS = "org_id string, month string, tokens bigint"


def test_meter_across_restarts(spark, folder):
    src = f"{folder}/in"
    for run, tokens in enumerate([300_000, 250_000]):
        spark.createDataFrame([("a", "2024-01", tokens), ("b", "2024-01", 1)], EVENTS).write.mode("append").parquet(src)
        stream = spark.readStream.schema(EVENTS).parquet(src)
        jobs.meter_tokens(stream, f"{folder}/out", f"{folder}/ck").awaitTermination()
        got = {r.org_id: (r.tokens_used, r.over_budget) for r in jobs.current_usage(spark, f"{folder}/out").collect()}
        assert got == {"a": ([300_000, 550_000][run], bool(run)), "b": (run + 1, False)}


def test_repeated_messages_are_stored_once(spark, folder):
    long = "a message that is long enough to keep {}"
    lines = [{"org_id": "o", "channel_id": "C", "type": "message", "text": long.format(i), "user": "U", "ts": f"{1700000000 + i}.000100"} for i in range(4)]
    os.makedirs(f"{folder}/in")
    channels = spark.createDataFrame([("o", "C", "c", False)], "org_id string, id string, name string, is_private boolean")
    profiles = spark.createDataFrame([("o", None)], "org_id string, slack_workspace_domain string")
    for unique in (True, False):
        for name, part in (("1.json", lines[:3]), ("2.json", lines[1:])):
            with open(f"{folder}/in/{unique}{name}", "w") as f:
                f.write("\n".join(map(json.dumps, part)))
        stream = spark.readStream.schema("org_id string, channel_id string, type string, text string, user string, subtype string, ts string, thread_ts string").option(
            "maxFilesPerTrigger", 1).option("pathGlobFilter", f"{unique}*.json").json(f"{folder}/in")
        out = f"{folder}/out{unique}"
        jobs.ingest_messages(stream, channels, profiles, out, f"{folder}/ck{unique}", hours_back=24,
                             now=lambda: F.timestamp_seconds(F.lit(1700000100)), unique=unique).awaitTermination()
        assert jobs.read_table(spark, out, "sources").count() == (4 if unique else 6)
        assert jobs.read_table(spark, out, "requests").count() == (4 if unique else 6)


def test_backfill_knows_earlier_batches(spark, folder):
    schema = "id bigint, org_id string, source_type string, raw_content string, processed_at timestamp"
    rows = [(i, "o", "slack_history", f"fact{i % 3} text", None) for i in range(24)] + [(99, "o", "email", "x", None), (98, "o", "slack_history", "x", datetime.datetime(2024, 1, 1))]
    entities = spark.createDataFrame([], "id bigint, org_id string, entity_type string, name string, status string")
    item = F.struct(F.col("idx").alias("message_index"), F.array(F.struct(
        F.lit("Client").alias("entity_type"), F.split_part("raw_content", F.lit(" "), F.lit(1)).alias("name"), F.lit("c").alias("content"))).alias("entities"))

    def extract(asked):
        packed = jobs.read_table(spark, f"{folder}/out", "packed").drop("batch_id")
        rows = asked.select("request_id", "org_id", "batch_no").join(packed, ["org_id", "batch_no"])
        return rows.groupBy("request_id").agg(F.to_json(F.collect_list(item)).alias("reply"))

    def criticise(c):
        return c.select("seq", F.lit('{"approved": true, "confidence_score": 0.9}').alias("reply"))

    for part in (rows[:14], rows[14:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        jobs.drain_backfill(stream, entities, f"{folder}/out", f"{folder}/ck", extract=extract, criticise=criticise).awaitTermination()
    stored = jobs.read_table(spark, f"{folder}/out", "entities").collect()
    assert sorted(r.name for r in stored) == ["fact0", "fact1", "fact2"]
    assert jobs.read_table(spark, f"{folder}/out", "processed").count() == 24
    assert jobs.read_table(spark, f"{folder}/out", "requests").agg(F.max("n")).first()[0] == 10


def chat_stream(spark, folder):
    return spark.readStream.schema("org_id string, channel_id string, type string, text string, user string, subtype string, ts string, thread_ts string").option(
        "maxFilesPerTrigger", 1).json(f"{folder}/in")


def drop(folder, name, messages):
    os.makedirs(f"{folder}/in", exist_ok=True)
    with open(f"{folder}/in/{name}.json", "w") as f:
        f.write("\n".join(json.dumps({"org_id": "o", "channel_id": "C", "type": "message", "text": f"a message that is long enough to keep {ts}", "user": "U", "ts": ts}) for ts in messages))


def test_late_messages_and_bad_rows(spark, folder):
    """Three triggers, the third days behind; a message comes twice, another has no time."""
    channels = spark.createDataFrame([("o", "C", "c", False)], "org_id string, id string, name string, is_private boolean")
    profiles = spark.createDataFrame([("o", None)], "org_id string, slack_workspace_domain string")
    for name, messages in (("1", ["1700400000.000100"]), ("2", ["1700400100.000100", "x.1"]), ("3", ["1700000000.000100", "1700400000.000100"])):
        drop(folder, name, messages)
        jobs.ingest_messages(chat_stream(spark, folder), channels, profiles, f"{folder}/out", f"{folder}/ck", unique=True).awaitTermination()
    stored = [r.id for r in jobs.read_table(spark, f"{folder}/out", "sources").collect()]
    assert sorted(stored) == [1700000000000100, 1700400000000100, 1700400100000100]


def test_copies_are_looked_for_in_their_own_days(spark, folder):
    """Stored keys of ten days; a batch with two of them reads two folders."""
    schema = "org_id string, channel_id string, ts string, timestamp timestamp"
    start = 1_700_006_400

    def rows(days, org="o"):
        df = spark.createDataFrame([(org, "C", f"{start + d * 86400 + i}.0") for d in days for i in range(3)], "org_id string, channel_id string, ts string")
        return df.withColumn("timestamp", F.timestamp_seconds(F.col("ts").cast("double").cast("bigint")))

    assert jobs.new_messages(rows(range(10)), f"{folder}/out", 0).count() == 30
    assert jobs.new_messages(rows([2, 7, 7, 11]), f"{folder}/out", 1).count() == 3
    assert jobs.new_messages(rows([2], "p"), f"{folder}/out", 2).count() == 3
    # A batch that is repeated doesn't meet its own keys.
    assert jobs.new_messages(rows([2, 7, 7, 11]), f"{folder}/out", 1).count() == 3
    days = rows([2, 7]).select(F.to_date("timestamp").alias("day")).distinct().filter("day > DATE'0001-01-01'")
    read = jobs.stored_keys(spark, f"{folder}/out").join(F.broadcast(days), "day", "left_semi")
    assert read.count() == 9
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan, plan
    assert str(rows([0]).schema["timestamp"].dataType.simpleString()) in schema


def test_requests_over_budget_wait(spark, folder):
    channels = spark.createDataFrame([("o", "C", "c", False)], "org_id string, id string, name string, is_private boolean")
    profiles = spark.createDataFrame([("o", None)], "org_id string, slack_workspace_domain string")
    seen = []
    for name, over in (("1", True), ("2", True), ("3", False)):
        drop(folder, name, [f"170040000{name}.000100"])
        budgets = lambda over=over: spark.createDataFrame([("o", over)], "org_id string, over_budget boolean")
        jobs.ingest_messages(chat_stream(spark, folder), channels, profiles, f"{folder}/out", f"{folder}/ck", budgets=budgets).awaitTermination()
        seen.append(jobs.read_table(spark, f"{folder}/out", "requests").count())
    assert seen == [0, 0, 3]


def test_unanswered_history_is_retried(spark, folder):
    """The first run gets no reply; the second has no new source and finds all of them."""
    schema = "id bigint, org_id string, source_type string, raw_content string, processed_at timestamp"
    spark.createDataFrame([(i, "o", "slack_history", f"fact{i} text", None) for i in range(13)], schema).write.parquet(f"{folder}/in")
    entities = spark.createDataFrame([], "id bigint, org_id string, entity_type string, name string, status string")
    item = F.struct(F.col("idx").alias("message_index"), F.array(F.struct(
        F.lit("Client").alias("entity_type"), F.col("raw_content").alias("name"), F.lit("c").alias("content"))).alias("entities"))

    def answer(asked):
        packed = jobs.read_table(spark, f"{folder}/out", "packed").drop("batch_id")
        rows = asked.select("request_id", "org_id", "batch_no").join(packed.distinct(), ["org_id", "batch_no"])
        return rows.groupBy("request_id").agg(F.to_json(F.collect_list(item)).alias("reply"))

    def criticise(c):
        return c.select("seq", F.lit('{"approved": true, "confidence_score": 0.9}').alias("reply"))

    def run(extract):
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        jobs.drain_backfill(stream, entities, f"{folder}/out", f"{folder}/ck", extract=extract, criticise=criticise, backoff=0).awaitTermination()
        return jobs.read_table(spark, f"{folder}/out", "processed").count(), jobs.read_table(spark, f"{folder}/out", "entities").count()

    assert run(lambda asked: asked.filter("false").select("request_id", F.lit("").alias("reply"))) == (0, 0)
    assert run(answer) == (13, 13)
    assert run(answer) == (13, 13)


def test_poison_is_given_up_and_budgets_wait(spark, folder):
    """One source never gets a usable reply, one organisation is over its budget for a while, a copy comes late."""
    schema = "id bigint, org_id string, source_type string, raw_content string, processed_at timestamp"
    entities = spark.createDataFrame([], "id bigint, org_id string, entity_type string, name string, status string")

    def extract(asked):
        packed = jobs.read_table(spark, f"{folder}/out", "packed")
        packed = packed.filter(F.col("batch_id") == packed.agg(F.max("batch_id")).first()[0]).drop("batch_id")
        item = F.struct(F.col("idx").alias("message_index"), F.array(F.struct(
            F.lit("Client").alias("entity_type"), F.col("raw_content").alias("name"), F.lit("c").alias("content"))).alias("entities"))
        good = asked.select("request_id", "org_id", "batch_no").join(packed, ["org_id", "batch_no"]).filter("raw_content <> 'poison'").distinct()
        return good.groupBy("request_id").agg(F.to_json(F.collect_list(item)).alias("reply"))

    def criticise(found):
        return found.select("org_id", "seq", F.lit('{"approved": true, "confidence_score": 0.9}').alias("reply"))

    def run(rows, over):
        if rows:
            spark.createDataFrame([(i, org, "slack_history", text, None) for i, org, text in rows], schema).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        limits = spark.createDataFrame([("poor", over)], "org_id string, over_budget boolean")
        jobs.drain_backfill(stream, entities, f"{folder}/out", f"{folder}/ck", extract=extract, criticise=criticise, backoff=0, tries=2,
                            budgets=lambda: limits).awaitTermination()

    def names():
        return sorted(r.name for r in jobs.read_table(spark, f"{folder}/out", "entities").collect())

    run([(1, "rich", "one"), (2, "bad", "poison"), (3, "poor", "later")], True)
    assert names() == ["one"]
    # The answered one comes again: nobody asks it twice.
    run([(1, "rich", "one"), (4, "rich", "four")], True)
    assert names() == ["four", "one"]
    run([], False)
    assert names() == ["four", "later", "one"]
    dead = jobs.read_table(spark, f"{folder}/out", "dead_letters").collect()
    assert [(r.org_id, r.id, r.raw_content, r.tries) for r in dead] == [("bad", 2, "poison", 2)]
    asked = jobs.read_table(spark, f"{folder}/out", "packed").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in asked} == {1: 1, 2: 2, 3: 1, 4: 1}


def test_organisations_may_share_source_ids(spark, folder):
    """Source 5 of one organisation is answered, then source 5 of another comes: both are stored, under ids of their own."""
    schema = "id bigint, org_id string, source_type string, raw_content string, processed_at timestamp"
    entities = spark.createDataFrame([], "id bigint, org_id string, entity_type string, name string, status string")

    def extract(asked):
        reply = F.to_json(F.array(F.struct(F.lit(0).alias("message_index"), F.array(F.struct(
            F.lit("Client").alias("entity_type"), F.col("org_id").alias("name"), F.lit("c").alias("content"))).alias("entities"))))
        return asked.select("request_id", reply.alias("reply"))

    def criticise(found):
        return found.select("org_id", "seq", F.lit('{"approved": true, "confidence_score": 0.9}').alias("reply"))

    for org in ("a", "b"):
        spark.createDataFrame([(5, org, "slack_history", f"text of {org}", None)], schema).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        jobs.drain_backfill(stream, entities, f"{folder}/out", f"{folder}/ck", extract=extract, criticise=criticise).awaitTermination()
    got = jobs.read_table(spark, f"{folder}/out", "entities").collect()
    assert sorted((r.org_id, r.name, r.source_id) for r in got) == [("a", "a", 5), ("b", "b", 5)]
    assert len({r.id for r in got}) == 2
    assert jobs.read_table(spark, f"{folder}/out", "processed").count() == 2


def test_meter_keeps_own_limits(spark, folder):
    events = spark.createDataFrame([("a", "2024-01", 600_000), ("b", "2024-01", 600_000)], "org_id string, month string, tokens bigint")
    events.write.parquet(f"{folder}/in")
    limits = spark.createDataFrame([("a", "2024-01", 1_000_000)], "org_id string, month string, budget_limit bigint")
    jobs.meter_tokens(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/ck", limits=lambda: limits).awaitTermination()
    assert {r.org_id: (r.budget_limit, r.over_budget) for r in jobs.current_usage(spark, f"{folder}/out").collect()} == {
        "a": (1_000_000, False), "b": (500_000, True)}


def beats(spark, src, rows):
    spark.createDataFrame(rows, "event_id bigint, process_name string, beat_at timestamp, status string, error string").write.mode("append").parquet(src)


@pytest.mark.parametrize("silent", [True, False])
def test_heartbeat_state_and_timer(spark, folder, silent):
    src = f"{folder}/in"
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    # The two-minute process may be three minutes late; it last beat just inside or long before that.
    beats(spark, src, [(1, "backfill_processor", now - datetime.timedelta(minutes=30), "ok", None),
                       (2, "backfill_processor", now - (datetime.timedelta(seconds=172) if silent else datetime.timedelta(minutes=20)), "error", "boom"),
                       (3, "evals", now, "ok", None), (4, "stranger", now, "ok", None)])
    stream = spark.readStream.schema("event_id bigint, process_name string, beat_at timestamp, status string, error string").parquet(src)
    query = heartbeats.watch(stream, f"{folder}/out", f"{folder}/ck", every="2 seconds" if silent else None)

    def states():
        try:
            return [r for r in jobs.read_table(spark, f"{folder}/out", "beats").filter("process_name = 'backfill_processor'").orderBy("batch_id").collect()]
        except Exception:  # noqa: BLE001 - nothing written yet
            return []

    if not silent:
        query.awaitTermination()
        assert [(r.last_status, r.overdue) for r in states()] == [("error", True)]
        got = jobs.read_table(spark, f"{folder}/out", "beats").select("process_name").distinct().collect()
        assert {r.process_name for r in got} == {"backfill_processor", "evals"}
        return
    until = time.time() + 60
    while time.time() < until and not any(r.overdue for r in states()):
        time.sleep(1)
    query.stop()
    seen = states()
    assert seen[-1].overdue and seen[-1].last_error == "boom"
