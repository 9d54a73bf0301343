"""Search against NumPy over every pair of a small fixture."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factlake.operators import search

N, DIM = 240, 8


@pytest.fixture(scope="module")
def data():
    rnd = np.random.default_rng(5)
    vec = rnd.normal(size=(N, DIM)).astype(np.float32)
    vec[10] = vec[3]  # an exact copy: the lower id comes first
    vec[11] = vec[3] * 2  # the same direction
    vec[12] = 0  # no direction at all
    org = ["hot" if i % 3 else f"o{i % 4}" for i in range(N)]
    return vec, org


def frames(spark, data):
    vec, org = data
    facts = spark.createDataFrame(
        [(i, org[i], [float(x) for x in vec[i]] if i != 20 else None, None if i % 9 else datetime.datetime(2024, 1, 1)) for i in range(N)],
        "id bigint, org_id string, embedding array<float>, superseded_at timestamp")
    queries = facts.filter("embedding IS NOT NULL").select("org_id", F.col("id").alias("query_id"), F.col("embedding").alias("vector"), F.col("id").alias("seq"))
    return facts, queries


def brute(data, k, earlier=False):
    vec, org = data
    v = vec.astype(np.float64)
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    out = {}
    for q in range(N):
        if q == 20:
            continue
        near = []
        for f in range(N):
            if org[f] != org[q] or f == 20 or f % 9 == 0 or (earlier and f >= q):
                continue
            d = np.inf if q == 12 or f == 12 else round(1 - float(unit[q] @ unit[f]), 9)
            near.append((d, f))
        out[q] = [f for _, f in sorted(near)[:k]]
    return {q: f for q, f in out.items() if f}


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("fact_block, query_block", [(10_000, 4_000), (13, 7), (5, 1000)])
@pytest.mark.parametrize("earlier", [False, True])
def test_many_queries(spark, data, fact_block, query_block, earlier):
    facts, queries = frames(spark, data)
    hits = search.top_k_many(
        queries, search.searchable(facts).withColumn("seq", F.col("id")), ["org_id"], 5,
        "seq" if earlier else None, "seq" if earlier else None, fact_block=fact_block, query_block=query_block)
    assert ranked(hits) == brute(data, 5, earlier)


def test_one_query_equals_many(spark, data):
    facts, queries = frames(spark, data)
    sources = spark.createDataFrame([], "id bigint, permalink string, source_type string")
    vector = F.array(*[F.lit(float(x)) for x in data[0][1]])
    hits = search.top_k(facts.withColumn("source_id", F.lit(None).cast("bigint")), sources, "hot", vector, 5).orderBy("distance", "id").collect()
    assert [r.id for r in hits] == brute(data, 5)[1]


def test_embedding(spark):
    df = spark.createDataFrame([(1, "red car, RED"), (2, "Red car red"), (3, ""), (4, None)], "id int, t string")
    got = {r.id: r.embedding for r in search.embed(df, "t", dim=64).collect()}
    assert got[1] == got[2] and len(got[1]) == 64
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6
    assert got[3] is None and got[4] is None

    def lengths(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: [float(len(t))])

    assert [r.embedding for r in search.embed(df, "t", embed_fn=lengths).orderBy("id").collect()] == [[12.0], [11.0], [0.0], [0.0]]


def test_access_rules(spark):
    from factlake.operators.access import is_open, visible_to

    rows = spark.createDataFrame(
        [(1, "o", "C1", False), (2, "o", "C2", True), (3, "o", "C3", True), (4, "o", None, None), (5, "o", "C2", None),
         (6, "o", "C3", None), (7, "p", "C1", False), (8, "o", None, True)],
        "id int, org_id string, channel_id string, channel_is_private boolean")
    members = spark.createDataFrame([("o", "C2", "U"), ("o", "C2", "U"), ("p", "C3", "U"), ("o", "C3", "V")], "org_id string, channel_id string, user_id string")
    assert sorted(r.id for r in visible_to(rows, members, "o", "U").collect()) == [1, 2, 4, 5, 8]
    assert sorted(r.id for r in rows.filter(is_open()).collect()) == [1, 4, 7, 8]


def test_channel_without_a_name_stays_closed(spark):
    facts = spark.createDataFrame([(1, "o", [1.0, 0.0], 1, None), (2, "o", [1.0, 0.1], 2, None)],
                                  "id bigint, org_id string, embedding array<float>, source_id bigint, superseded_at timestamp")
    sources = spark.createDataFrame([(1, "", True), (2, "open", False)], "id bigint, channel_id string, channel_is_private boolean")
    asked = spark.createDataFrame([(7, "o", "nobody", [1.0, 0.0]), (8, "o", "member", [1.0, 0.0])], "query_id bigint, org_id string, user_id string, vector array<float>")
    members = spark.createDataFrame([("o", "", "member")], "org_id string, channel_id string, user_id string")
    assert ranked(search.top_k_many_visible(asked, facts, sources, members)) == {7: [2], 8: [1, 2]}


def test_vectors_of_other_lengths_do_not_meet(spark):
    facts = spark.createDataFrame([(1, "o", [1.0, 0.0]), (2, "o", [1.0]), (3, "o", [0.5, 0.5])], "id bigint, org_id string, embedding array<float>")
    asked = spark.createDataFrame([(7, "o", [1.0, 0.0]), (8, "o", [2.0]), (9, "o", [1.0, 2.0, 3.0])], "query_id bigint, org_id string, vector array<float>")
    assert ranked(search.top_k_many(asked, facts, ["org_id"])) == {7: [1, 3], 8: [2]}
