"""Cases that once lost rows, leaked or failed."""

import base64
import random

from pyspark.sql import functions as F

from factlake.functions.text import decode_base64url
from factlake.operators import evals, held, ingest, memory, review, routing, tasks
from factlake.sources import mail, tables

CANDIDATE = ("seq bigint, org_id string, source_id bigint, entity_type string, name string, content string, approved boolean, "
             "confidence_score double, critic_reason string")


def batch(spark):
    rows = [(i, "o", i // 2, "Client", f"n{i}", "c", i % 2 == 0, 0.9 if i % 2 == 0 else 0.6, None) for i in range(80)]
    entities = spark.createDataFrame([], "id bigint, org_id string, entity_type string, name string, status string")
    edges = spark.createDataFrame([], "source_id bigint, from_name string, from_type string, relationship_type string, to_name string, to_type string")
    queue = spark.createDataFrame([], "org_id string, waiting bigint")
    return spark.createDataFrame(rows, CANDIDATE), edges, entities, queue


def test_sources_at_a_full_queue_are_held(spark):
    candidates, edges, entities, queue = batch(spark)
    sinks = ingest.store_batch(candidates, edges, entities, queue)
    held = sinks.held.collect()
    assert len(held) == 40 and sinks.held.columns == candidates.columns
    assert sinks.entities.count() + sinks.pending.count() + len(held) == 80
    # Given again once the queue is worked off, nothing is lost.
    again = ingest.store_batch(sinks.held, edges, entities, queue)
    assert again.entities.count() + again.pending.count() == 40 and again.held.count() == 0
    free = ingest.store_batch(candidates, edges, entities, queue, cap=None)
    assert free.entities.count() + free.pending.count() == 80 and free.held.count() == 0


def test_held_sources_come_in_as_a_fold_would_let_them(spark):
    """Against one source and one review after another; one organisation has nearly everything."""
    rng = random.Random(3)
    waiting = {"hot": 25, "cold": 3, "full": 40}
    sources = [("hot", i * 11) for i in range(300)] + [("cold", i) for i in range(4)] + [("full", 7)]
    rows = [(org, s, rng.choice(["pending", "pending", "approved"])) for org, s in sources for _ in range(rng.randrange(1, 4))]
    reviews = [("hot", n, rng.randrange(0, 5)) for n in range(1, 160)] + [("cold", 1, 2), ("full", 9, 5)]
    want = {}
    for org in waiting:
        line = sorted({s for o, s, _ in rows if o == org})
        now = waiting[org]
        for no, taken in [(0, 0), *sorted((n, t) for o, n, t in reviews if o == org)]:
            now -= taken
            while line and now < routing.QUEUE_CAP and (taken or not no):
                s = line.pop(0)
                pending = sum(1 for o, x, r in rows if (o, x, r) == (org, s, "pending"))
                now += pending
                want[org, s] = (pending, no)
        want |= {(org, s): (sum(1 for o, x, r in rows if (o, x, r) == (org, s, "pending")), None) for s in line}
    df = spark.createDataFrame(rows, "org_id string, source_id bigint, route string")
    queue = spark.createDataFrame(list(waiting.items()), "org_id string, waiting bigint")
    found = held.released(df, queue, spark.createDataFrame(reviews, "org_id string, review_no bigint, taken bigint"))
    assert {(r.org_id, r.source_id): (r.pending, r.released_by) for r in found.collect()} == want
    assert {b for _, b in want.values()} >= {0, None} and len({b for _, b in want.values()}) > 20
    free, still = held.replay(df, found)
    assert free.count() + still.count() == len(rows) and still.select("source_id").distinct().count() == sum(b is None for _, b in want.values())


def test_contradictions_are_queued(spark):
    candidates, edges, entities, queue = batch(spark)
    notes = spark.createDataFrame([(i, "o", i // 2, "Client", f"n{i}", f"NEW: {i}", "why", 0.5, "contradiction") for i in (0, 2, 78)],
                                  "id bigint, org_id string, source_id bigint, entity_type string, name string, content string, critic_reason string, "
                                  "confidence_score double, review_type string")
    sinks = ingest.store_batch(candidates, edges, entities, queue, contradictions=notes)
    found = {r.source_id: r.content for r in sinks.pending.filter("review_type = 'contradiction'").collect()}
    assert found == {0: "NEW: 0", 1: "NEW: 2"}


def test_bad_base64_is_an_empty_body(spark):
    texts = ["a", "####", None, "", "aGk", "aGk=", base64.urlsafe_b64encode("ü?>~".encode()).decode().rstrip("="), "aG\nk="]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(decode_base64url(F.col("t")).alias("x")).collect()] == [None, None, None, "", "hi", "hi", "ü?>~", "hi"]


def test_mailbox_has_no_cap_of_its_own(spark):
    body = base64.urlsafe_b64encode(b"text").decode()
    rows = [(i, "o", [], 1_700_000_000_000 + i, ("text/plain", [], (body,), [])) for i in range(150)]
    df = spark.createDataFrame(rows, mail.MAIL)
    now = F.timestamp_seconds(F.lit(1_700_000_100))
    assert mail.import_mailbox(df, now).count() == 150
    assert mail.import_mailbox(df, now, cap=100).count() == 100


def test_several_verdicts_block_once(spark):
    task = spark.createDataFrame([(1, "o", "draft")], "query_id bigint, org_id string, task_type string")
    verdicts = spark.createDataFrame([(1, False, None), (1, True, "b2"), (1, True, "b1")], "query_id bigint, conflict boolean, belief string")
    got = tasks.gate_tasks(
        task, spark.createDataFrame([(1,)], "query_id bigint"), spark.createDataFrame([("o",)], "org_id string"), verdicts,
        spark.createDataFrame([], "query_id bigint, contradiction boolean, reason string"), spark.createDataFrame([(1, "d")], "query_id bigint, draft string")).collect()
    assert [(r.blocked, r.result) for r in got] == [(True, "BLOCKED: Action blocked by Belief: b1")]


def test_repeated_changes_apply_once(spark):
    profiles = spark.createDataFrame([("o", "old")], "org_id string, briefing_focus string")
    changes = spark.createDataFrame([("o", "first", 1), ("o", "last", 2)], "org_id string, briefing_focus string, seq int")
    assert [r.briefing_focus for r in memory.set_briefing_focus(profiles, changes)[0].collect()] == ["last"]
    checks = spark.createDataFrame([(1, "q")], "id bigint, question string")
    results = spark.createDataFrame([(1, 0.0, "a", 1), (1, 1.0, "b", 2)], "id bigint, score double, actual string, seq int")
    assert [r.last_score for r in evals.write_back(checks, results, F.current_timestamp()).collect()] == [1.0]
    pending = spark.createDataFrame([(1, "o", "Client", "n", "c", 5)], "id bigint, org_id string, entity_type string, name string, content string, source_id bigint")
    asked = spark.createDataFrame([(1, "amy", 1), (1, "bob", 2)], "id bigint, approved_by string, seq int")
    assert [r.approved_by for r in review.approve(pending, asked)[0].collect()] == ["bob"]


def test_csv_headers_may_be_called_file_and_row_no(spark, folder):
    with open(f"{folder}/x.csv", "w") as f:
        f.write("file,row_no,name\nf1,7,A\nf2,8,B\n")
    got = tables.csv_facts(tables.read_csv(spark, f"{folder}/x.csv"), "o", "Client").orderBy("row_no").collect()
    assert [(r.row_no, r.name, r.content) for r in got] == [(1, "A", "file: f1, row_no: 7, name: A"), (2, "B", "file: f2, row_no: 8, name: B")]
