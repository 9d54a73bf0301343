"""Tables kept by organisation: what a batch rewrites, and what it leaves alone."""

import os
import re

import pytest
from pyspark.sql import functions as F

from factlake.operators import memory, parted

FACT = "id bigint, org_id string, entity_type string, status string, superseded_at timestamp, superseded_by_id bigint"
def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


def files(table):
    return {os.path.join(at, n): os.stat(os.path.join(at, n)).st_mtime_ns
            for at, _, names in os.walk(f"{table.path}/rows") for n in names if n.endswith(".parquet")}


@pytest.fixture
def facts(spark, folder):
    rows = [(i, "hot" if i % 3 else f"o{i % 5}", "Client", "active", None, None) for i in range(400)]
    df = spark.createDataFrame(rows, FACT)
    return parted.Parted(f"{folder}/facts", df.schema, "id", 8).create(df)


def test_only_touched_folders_are_rewritten(spark, facts):
    before, rows = files(facts), {r.id: r for r in facts.read(spark).collect()}
    changes = spark.createDataFrame([(1, "hot", 1, 2), (2, "hot", 4, 99_999), (3, "o0", 1, 2), (4, None, 5, 7)], "seq bigint, org_id string, old_id bigint, new_id bigint")
    whole = sorted(memory.supersede(facts.read(spark), changes, now())[0].collect())
    assert parted.supersede(facts, "one", changes, now())
    after = files(facts)
    places = {re.search(r"org_id=[^/]+/bucket=\d+", f).group() for f in before.keys() ^ after.keys()}
    assert 0 < len(places) <= 5 and all(after[f] == t for f, t in before.items() if f in after)
    assert {p.split("/")[0] for p in places} <= {"org_id=hot", "org_id=o0"}
    assert sorted(facts.read(spark).select(*whole[0].__fields__).collect()) == whole
    assert len(rows) == len(whole) == 400 and sum(r.status == "superseded" for r in whole) == 1
    # The same batch again changes nothing, not even files.
    assert not parted.supersede(facts, "one", changes, now())
    assert files(facts) == after


def test_a_batch_that_broke_off_can_be_repeated(spark, facts, monkeypatch):
    """The folders were replaced, but the marker wasn't written."""
    done = spark.createDataFrame([("hot", 1), ("hot", 1), ("o0", 0), ("nobody", 3)], "org_id string, id bigint")
    sources = parted.Parted(f"{facts.path}-s", spark.createDataFrame([], "id bigint, org_id string, processed_at timestamp").schema, "id", 4)
    sources.create(spark.createDataFrame([(i, "hot" if i % 3 else "o0", None) for i in range(60)], sources.schema))
    for _ in range(2):
        monkeypatch.setattr(parted.Parted, "done", lambda *_: False)
        assert parted.mark_processed(sources, "b", done, now())
    monkeypatch.undo()
    assert not parted.mark_processed(sources, "b", done, now())
    got = sources.read(spark).collect()
    assert len(got) == 60 and {(r.org_id, r.id) for r in got if r.processed_at} == {("hot", 1), ("o0", 0)}


def test_nodes_are_added_and_changed(spark, folder):
    nodes = spark.createDataFrame([(1, "a", "Client", "one", "old"), (2, "b", "Client", "two", "old")],
                                  "entity_id bigint, org_id string, entity_type string, name string, content string")
    table = parted.Parted(f"{folder}/nodes", nodes.schema, "entity_id", 4)
    change = "seq int, entity_id bigint, org_id string, entity_type string, name string, content string"
    # The table need not exist, and an empty batch is a batch.
    assert table.read(spark).count() == 0
    assert parted.upsert_nodes(table, "none", spark.createDataFrame([], change))
    table.create(nodes)
    parted.upsert_nodes(table, "1", spark.createDataFrame(
        [(2, 1, "a", "Person", "x", "new"), (1, 1, "a", "Person", "y", "mid"), (3, 3, "a", "Person", None, "made"), (4, 1, "b", "Person", "own", "other")], change))
    assert sorted(tuple(r) for r in table.read(spark).select("org_id", "entity_id", "entity_type", "name", "content").collect()) == [
        ("a", 1, "Client", "one", "new"), ("a", 3, "Person", "", "made"), ("b", 1, "Person", "own", "other"), ("b", 2, "Client", "two", "old")]


def test_listings_read_one_organisation(spark, facts):
    page = memory.page_total(facts.read(spark), "o1", "Client")
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*org_id[^\]]*= o1", plan), plan
    assert page.first().total == sum(1 for i in range(400) if not i % 3 and i % 5 == 1)
    touched = facts.touched(spark, spark.createDataFrame([("o1", 6)], "org_id string, id bigint"))
    assert 0 < touched.count() < page.first().total
    assert "dynamicpruning" in touched._jdf.queryExecution().executedPlan().toString()
