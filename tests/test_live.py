"""Replies to stored facts, with contradictions looked up among earlier facts."""

import hashlib
import json

from pyspark.sql import functions as F

from factlake.operators import ingest, live, requests, search


def number(org, source, pos):
    return int(hashlib.md5(f"{org}/{source}/{pos}".encode()).hexdigest()[:15], 16)


def test_replies_to_sinks(spark, folder):
    keep = ingest.keep_under(folder)

    def reply(*entities, edges=()):
        return json.dumps({"entities": [dict(entity_type=t, name=n, content=c) for t, n, c in entities],
                           "relationships": [dict(from_name=a, to_name=b, relationship_type=k) for a, b, k in edges]})

    extractions = spark.createDataFrame([
        (1, "o", reply(("Client", "Acme", "red car sold"), ("Person", "Ann", "Ann leads"), edges=[("Ann", "Acme", "owns"), ("Ann", "Nobody", "owns")])),
        (2, "o", reply(("Client", "Acme", "red car not sold"), ("Person", "Bob", "Bob helps"), ("Person", None, "red car sold"), edges=[("Bob", "Acme", None)])),
        (3, "o", "no json"), (4, "p", reply(("Client", "Acme", "red car sold")))], "source_id bigint, org_id string, reply string")
    candidates, edges = live.proposals(extractions)
    own = {(o, s, p): number(o, s, p) for o, s, p in (("o", 1, 0), ("o", 1, 1), ("o", 2, 0), ("o", 2, 1), ("o", 2, 2), ("p", 4, 0))}
    assert {(r.org_id, r.source_id, r.pos): r.seq for r in candidates.collect()} == own
    acme, ann, bob, again = (own["o", s, p] for s, p in ((1, 0), (1, 1), (2, 1), (2, 2)))
    verdicts = candidates.select("seq", F.when(F.col("seq") == bob, '{"confidence_score": 0.6}').otherwise('{"approved": true, "confidence_score": 0.9}').alias("reply"))
    entities = spark.createDataFrame(
        [(7, "o", "Client", "Old", "red car sold", "active", 1, None)],
        "id bigint, org_id string, entity_type string, name string, content string, status string, source_id bigint, superseded_at timestamp")

    def embed(df):
        return search.embed(df, "content", dim=64)

    seen = []

    def check(blocks):
        seen.extend(requests.contradiction_requests(blocks).collect())
        return blocks.select("query_id", F.when(F.col("query_id") == again, '{"contradiction": true, "reason": "again"}').otherwise("?").alias("reply"))

    stored = keep(embed(entities), "stored")
    scored = keep(live.scored(candidates, verdicts), "scored")
    notes = live.contradictions(scored, stored, embed, check, keep=keep)
    # The second Acme is a repeat; Bob waits for review; every other new fact but the one of p has an older one.
    assert {r.request_id for r in seen} == {str(acme), str(ann), str(again)}
    note = notes.collect()
    assert len(note) == 1 and note[0].id == again and note[0].review_type == "contradiction" and note[0].critic_reason == "again"
    listed = json.loads(note[0].content.split("CONFLICTS WITH: ")[1].split("\n\nREASON")[0])
    assert [e["content"] for e in listed][:2] == ["red car sold", "red car sold"] and listed[0]["name"] == "Old"
    assert note[0].content.startswith("NEW: red car sold\n\n") and note[0].content.endswith("REASON: again")

    queue = spark.createDataFrame([("o", 18)], "org_id string, waiting bigint")
    sinks = live.store_replies(extractions, verdicts, entities, queue, notes=notes, keep=keep)
    assert sorted(r.id for r in sinks.entities.collect()) == sorted([acme, ann, again, own["p", 4, 0]])
    assert sorted((r.from_id, r.to_id, r.relationship_type) for r in sinks.edges.collect()) == [(ann, acme, "owns")]
    # Bob and the note on the fact that contradicts an older one.
    assert sorted((r.seq, r.review_type) for r in sinks.pending.collect()) == sorted([(bob, "standard"), (again, "contradiction")])
    assert sinks.paused.count() == 0


def test_include_self(spark):
    new = spark.createDataFrame([(5, "o", "Client", "a", "c", 1, [1.0, 0.0], 9)], "id bigint, org_id string, entity_type string, name string, content string, source_id bigint, embedding array<float>, seq bigint")
    none = spark.createDataFrame([], "id bigint, org_id string, entity_type string, name string, content string, source_id bigint, embedding array<float>, superseded_at timestamp")
    assert live.resembling(new, none).count() == 0
    assert [r.id for r in live.resembling(new, none, include_self=True).collect()] == [5]


def test_replies_of_any_length(spark):
    """The items after the first thousand of a source have numbers of their own and keep their order."""
    def reply(names):
        return json.dumps({"entities": [dict(entity_type="Client", name=n, content=f"{n} {i}") for i, n in enumerate(names)]})

    long = [f"a{i}" for i in range(1000)] + ["late", "both", "late"] + [f"b{i}" for i in range(500)]
    found = spark.createDataFrame([(1, "o", reply(long)), (2, "o", reply(["both", "own"])), (1, "p", reply(["other"]))], "source_id bigint, org_id string, reply string")
    candidates, edges = live.proposals(found)
    verdicts = candidates.select("org_id", "seq", F.to_json(F.struct(F.lit(True).alias("approved"), F.lit(0.9).alias("confidence_score"))).alias("reply"))
    scored = live.scored(candidates, verdicts)
    assert scored.count() == len(long) + 3
    assert scored.filter("org_id = 'o'").select("seq").distinct().count() == len(long) + 2
    none = spark.createDataFrame([], "id bigint, org_id string, entity_type string, name string, content string, status string, source_id bigint, superseded_at timestamp, embedding array<float>")
    queue = spark.createDataFrame([], "org_id string, waiting bigint")
    stored = live.store_replies(found, verdicts, none, queue).entities.filter("org_id = 'o'").collect()
    assert len({r.id for r in stored}) == len(stored) == len(set(long)) + 1
    assert {r.content for r in stored if r.name in ("late", "both")} == {"late 1000", "both 1001"}
    # A late item meets those before it in its source, not those of the next.
    few = scored.filter("org_id = 'o' AND name IN ('a0', 'late', 'own') AND (name != 'late' OR pos = 1000)").withColumn("id", F.col("seq"))
    near = live.resembling(few.withColumn("embedding", F.array(F.lit(1.0).cast("float"))), none)
    names = {r.seq: r.name for r in few.collect()}
    assert sorted((names[r.query_id], names[r.id]) for r in near.collect()) == [("late", "a0"), ("own", "a0"), ("own", "late")]
