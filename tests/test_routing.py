"""Routing, cap and storing against a sequential fold in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from factlake.operators import ingest, routing

SCHEMA = ("seq bigint, org_id string, source_id bigint, entity_type string, name string, content string, approved boolean, "
          "confidence_score double, critic_reason string")
ENTITY = "id bigint, org_id string, entity_type string, name string, status string"


def make(seed, n=400):
    rnd = random.Random(seed)
    rows, source = [], 0
    for seq in range(n):
        source += rnd.random() < 0.4
        org = "hot" if source % 3 else f"o{source % 5}"
        name = rnd.choice([None, "", *[f"n{i}" for i in range(12)]])
        rows.append((seq, org, source, rnd.choice(["Client", "Person"]), name, f"c{seq}", rnd.random() < 0.6, rnd.choice([0.3, 0.5, 0.6, 0.7, 0.9]), "r"))
    entities = [(10_000 + i, "hot", "Client", f"n{i}", "active" if i % 2 else "superseded") for i in range(4)]
    queue = {"o1": 20, "o2": 18, "hot": rnd.randrange(0, 15)}
    return rows, entities, queue


def fold(rows, entities, queue, edges):
    """One source after the other, as a single worker would do it."""
    waiting, known = dict(queue), {(o, t, n): i for i, o, t, n, s in entities if s == "active"}
    stored, pending, logs, paused, out_edges = set(), set(), set(), set(), []
    for source in sorted({r[2] for r in rows}):
        mine = [r for r in rows if r[2] == source]
        org = mine[0][1]
        if waiting.get(org, 0) >= 20:
            paused.add((org, source))
            continue
        ids, added = {}, 0
        for seq, _, _, kind, name, _, ok, score, _ in mine:
            if ok and score >= 0.7:
                if name and (org, kind, name) in known:
                    ids[name] = known[org, kind, name]
                    continue
                stored.add(seq)
                if name:
                    known[org, kind, name] = ids[name] = 1_000_000 + seq
            elif score >= 0.5:
                pending.add(seq)
                added += 1
            else:
                logs.add(seq)
        out_edges += [(ids[a], ids[b]) for s, a, b in edges if s == source and a in ids and b in ids]
        waiting[org] = waiting.get(org, 0) + added
    return stored, pending, logs, paused, sorted(out_edges)


@pytest.mark.parametrize("seed", range(4))
def test_store_batch_equals_fold(spark, folder, seed):
    rows, entities, queue = make(seed)
    rnd = random.Random(seed + 100)
    edges = [(r[2], rnd.choice([f"n{i}" for i in range(12)]), rnd.choice([f"n{i}" for i in range(12)])) for r in rows]
    sinks = ingest.store_batch(
        spark.createDataFrame(rows, SCHEMA),
        spark.createDataFrame([(*e, None) for e in edges], "source_id bigint, from_name string, to_name string, relationship_type string"),
        spark.createDataFrame(entities, ENTITY), spark.createDataFrame(list(queue.items()), "org_id string, waiting bigint"),
        id_base=1_000_000, keep=ingest.keep_under(folder) if seed % 2 else None)
    stored, pending, logs, paused, linked = fold(rows, entities, queue, edges)
    assert {r.seq for r in sinks.entities.collect()} == stored
    assert {r.seq for r in sinks.pending.collect()} == pending
    assert {r.seq for r in sinks.rejected.collect()} == logs
    assert {(r.org_id, r.source_id) for r in sinks.paused.collect()} == paused
    got = sinks.edges.collect()
    assert sorted((r.from_id, r.to_id) for r in got) == linked
    assert all(r.relationship_type == "related_to" for r in got)


def test_contradictions_fill_the_queue(spark):
    rows = [(i, "o", i, "Client", f"n{i}", "c", True, 0.9, "") for i in range(40)]
    notes = spark.createDataFrame([("o", i) for i in range(40)], "org_id string, source_id bigint")
    empty = spark.createDataFrame([], "org_id string, waiting bigint")
    sinks = ingest.store_batch(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "source_id bigint, from_name string, to_name string, relationship_type string"),
        spark.createDataFrame([], ENTITY), empty, contradictions=notes)
    assert sorted(r.seq for r in sinks.entities.collect()) == list(range(20))
    assert sinks.paused.count() == 20


def test_scores_at_the_borders(spark):
    rows = [(i, "o", 1, "Client", None, "c", ok, s, "") for i, (ok, s) in enumerate(
        [(True, 0.7), (True, 0.69), (False, 0.99), (True, 0.5), (True, 0.49), (True, 0.8), (True, 0.79)])]
    df = spark.createDataFrame(rows, SCHEMA)
    live = [r.route for r in routing.route(df).orderBy("seq").collect()]
    late = [r.route for r in routing.route(df, routing.BACKFILL_THRESHOLD).orderBy("seq").collect()]
    assert live == ["approved", "pending", "pending", "pending", "rejected", "approved", "approved"]
    assert late == ["pending", "pending", "pending", "pending", "rejected", "approved", "pending"]


def test_written_batch_replaces_itself(spark, folder):
    rows, entities, _ = make(1, 60)
    for _ in range(2):
        sinks = ingest.store_backfill(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(entities, ENTITY))
        ingest.write(sinks, folder, 0)
    stored = spark.read.parquet(f"{folder}/entities")
    assert stored.count() == stored.select("seq").distinct().count() == sinks.entities.count()


def test_rejection_text(spark):
    df = spark.createDataFrame([(1, "o", 1, "Client", None, "c", False, 0.1, "weak")], SCHEMA)
    assert routing.rejection_logs(df).first().content == "REJECTED: None — c — Reason: weak"
    assert routing.rejection_logs(df, with_reason=False).first().content == "REJECTED: None — c"


def test_counters(spark):
    df = routing.route(spark.createDataFrame(make(2)[0], SCHEMA))
    total = routing.run_counters(df).first()
    assert total.proposed == 400 == total.approved + total.rejected + total.pending
    per = routing.run_counters(df, "source_id").agg(F.sum("approved")).first()[0]
    assert per == total.approved
