"""Coverage of the inventory, and plans that must keep their shape."""

import re

import pytest
from pyspark.sql import functions as F

from factlake.operators import memory, requests, routing, search
from factlake.plans import catalog  # noqa: F401
from factlake.plans.registry import QUERIES, Tables

from .conftest import SMALL

INVENTORY = {"T2a", "T2b", "U1"} | {
    f"{kind}{n}" for kind, last in
    {"S": 18, "T": 16, "L": 11, "J": 10, "A": 10, "W": 4, "R": 2, "V": 5, "G": 4, "C": 6, "M": 11, "H": 4, "ST": 7}.items()
    for n in range(1, last + 1)}


def test_every_operator_has_a_query():
    covered = {op for q in QUERIES.values() for op in q.ops.split()}
    assert covered == INVENTORY


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def details(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("stored"))
    Tables(spark, SMALL)("fx_sources").write.partitionBy("org_id").parquet(f"{base}/sources")
    Tables(spark, SMALL)("fx_entities").write.partitionBy("org_id").parquet(f"{base}/entities")
    return lambda name: spark.read.parquet(f"{base}/{name}")


def test_backlog_is_pushed_down(stored):
    text = details(requests.backlog(stored("sources")).filter("org_id = 'org0'").select("id"))
    pushed = re.search(r"PushedFilters: (.*)", text).group(1)
    assert "IsNull(processed_at)" in pushed and "EqualTo(source_type,slack_history)" in pushed
    assert "raw_content" not in text.split("ReadSchema")[1]
    assert "PartitionFilters: [isnotnull(org_id" in text


def test_listing_reads_no_vectors(stored):
    text = details(memory.page(stored("entities"), "org1").select("id", "name"))
    assert "TakeOrderedAndProject" in text or "GlobalLimit" in text
    assert "embedding" not in text.split("ReadSchema")[1]


def test_search_moves_distances_not_vectors(spark, stored):
    members = spark.createDataFrame([("org1", "C1", "U3")], "org_id string, channel_id string, user_id string")
    vector = F.array(*[F.lit(0.5)] * 64)
    text = plan(search.top_k_visible(stored("entities"), stored("sources"), members, "org1", "U3", vector))
    assert "TakeOrderedAndProject" in text
    # The vector is read and used below the first exchange and nowhere above it.
    above = text[:text.index("Exchange")] if "Exchange" in text else text
    assert "embedding" not in above


def test_groups_are_cut_before_the_shuffle(spark):
    t = Tables(spark, SMALL)
    for df in (
        routing.first_of_name(routing.route(t("fx_candidates"))),
        memory.latest_logs(t("fx_logs"), "daily_briefing"),
        routing.queue_cutoffs(routing.pending_per_source(routing.route(t("fx_candidates"))), spark.createDataFrame([], "org_id string, waiting bigint")),
    ):
        assert "WindowGroupLimit" in plan(df)
