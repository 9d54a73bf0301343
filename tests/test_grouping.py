"""Grouping helpers on data where one key holds most rows, against plain Python."""

import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factlake.operators import context, messages
from factlake.operators import requests
from factlake.operators.grouping import first_k, fresh_keys, group_ordinal, id_slice, ordered_texts, range_least_after, range_ordinal


@pytest.fixture(scope="module")
def hot(spark):
    """300 rows, two thirds under one key, one key null, ids scattered."""
    rows = [(i * 7 % 1000, "hot" if i % 3 else (None if i % 2 else f"k{i % 5}")) for i in range(300)]
    return spark.createDataFrame(rows, "id bigint, k string").cache()


def by_key(df):
    groups = defaultdict(list)
    for r in df.collect():
        groups[r.k].append(r)
    return groups


def test_group_ordinal(hot):
    got = group_ordinal(hot, ["k"], [id_slice("id", 50)], [F.col("id")])
    for rows in by_key(got).values():
        rows = sorted(rows, key=lambda r: r.id)
        assert [r.ordinal for r in rows] == list(range(1, len(rows) + 1))
    assert got.count() == 300


def test_group_ordinal_descending_slices(hot):
    slices = [("top", F.floor(F.col("id") / 100), False)]
    for rows in by_key(group_ordinal(hot, ["k"], slices, [F.desc("id")])).values():
        rows = sorted(rows, key=lambda r: -r.id)
        assert [r.ordinal for r in rows] == list(range(1, len(rows) + 1))


def test_range_ordinal(spark, hot):
    """Ids far apart, a hot key, a null key, columns with names of helpers; no window takes rows."""
    wide = hot.select((F.col("id") * 1_000_003 + 1_700_000_000_000_000).alias("id"), "k", F.lit("x").alias("part"), F.lit(1).alias("n"))
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = range_ordinal(wide, ["k"], ["id"])
            assert got.columns == ["id", "k", "part", "n", "ordinal"]
            for rows in by_key(got).values():
                assert [r.ordinal for r in sorted(rows, key=lambda r: r.id)] == list(range(1, len(rows) + 1))
            assert got.count() == 300
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert range_ordinal(wide.filter("false"), ["k"], ["id"]).count() == 0


def test_batches_of_scattered_ids(spark):
    rows = [(i * i * 7_919_000_000 + i, "hot" if i % 4 else "cold") for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, org_id string").repartition(6)
    got = requests.pack_batches(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan
    for org in ("hot", "cold"):
        mine = sorted((r for r in got.collect() if r.org_id == org), key=lambda r: r.id)
        assert [(r.batch_no, r.idx) for r in mine] == [(i // 10, i % 10) for i in range(len(mine))]


@pytest.mark.parametrize("width", [3, 50, 100_000])
def test_ordered_texts(hot, width):
    """The same text whatever the slices."""
    lines = hot.withColumn("line", F.when(F.col("id") % 5 > 0, F.concat(F.lit("l"), F.col("id").cast("string"))))
    got = ordered_texts(lines, ["k"], [("slice_no", F.floor(F.col("id") / width), False)], "id DESC", {"text": ("line", "|")},
                        [("n", F.count("*"), F.sum("n"))])
    rows = by_key(hot)
    for r in got.collect():
        ids = sorted((x.id for x in rows[r.k]), reverse=True)
        assert (r.text or "") == "|".join(f"l{i}" for i in ids if i % 5 > 0)
        assert r.n == len(ids)


def test_first_k(hot):
    got = by_key(first_k(hot, ["k"], [F.col("id")], 4))
    for key, rows in by_key(hot).items():
        assert sorted(r.id for r in got[key]) == sorted(r.id for r in rows)[:4]


def test_hot_key_of_a_lookup_is_split(spark):
    """The join to an aggregated lookup is split by AQE, and its rows stay right."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(40000).repartition(8).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 100).cast("string"))).alias("k"))
        lookup = rows.groupBy("k").agg(F.min("id").alias("first"))
        joined = rows.join(fresh_keys(lookup, "k"), "k", "left")
        joined.write.format("noop").mode("overwrite").save()
        assert joined.filter("first IS NULL").count() == 0
        df = rows.join(fresh_keys(lookup, "k"), "k", "left")
        assert len(df.collect()) == 40000
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def thread(spark, n):
    rows = [(i, "o", "C1", False, f"U{i}", None, f"{i}.0", "0.0", f"reply {i}") for i in range(1, n + 1)]
    rows += [(1000 + i, "o", "C1", False, "U", None, f"{i}.5", f"{i}.5" if i % 2 else None, f"alone {i}") for i in range(3)]
    rows += [(2000 + i, "o", "C2", False, "U", None, f"{i}.7", "0.0", f"other {i}") for i in range(2)]
    return spark.createDataFrame(rows, "msg_id bigint, org_id string, channel_id string, channel_is_private boolean, "
                                       "user_id string, subtype string, ts string, thread_ts string, content string")


def test_thread_is_one_row_at_any_size(spark):
    msgs = thread(spark, 50)
    whole = {r.channel_id: r for r in messages.bundle_threads(msgs).filter("replies > 0").collect()}
    assert whole["C1"].content == "[Thread]\n" + "\n---\n".join(f"reply {i}" for i in range(1, 51))
    assert whole["C1"].user_id == "U1" and whole["C1"].replies == 50 and whole["C1"].msg_id == 1
    for width in (1, 5, 17):
        assert sorted(messages.bundle_threads(msgs, slice_width=width).collect(), key=repr) == sorted(messages.bundle_threads(msgs).collect(), key=repr)


def test_clean_chain_order(spark):
    """Noise goes first, so text that a footer filled alone stays as an empty message."""
    rows = [(1, "o", "C", False, "U", None, "1", None, "Sent using Claude. Sent via ChatGPT."),
            (2, "o", "C", False, "U", None, "2", None, "ok"),
            (4, "o", "C", False, "U", None, "4", "9", "the later reply of the thread"),
            (3, "o", "C", False, "U", None, "3", "9", "the first reply of the thread")]
    msgs = spark.createDataFrame(rows, thread(spark, 1).schema)
    got = {r.msg_id: r.content for r in messages.clean_messages(msgs).collect()}
    assert got == {1: "", 3: "[Thread]\nthe first reply of the thread\n---\nthe later reply of the thread"}


def test_snapshot_is_one_row(spark):
    facts = spark.sql("""SELECT id, 'o' AS org_id, CASE id % 2 WHEN 0 THEN 'Client' ELSE 'Belief' END AS entity_type, 'n' || id AS name, 'c' AS content,
      CAST(NULL AS TIMESTAMP) AS superseded_at, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT), 0, 0) AS created_at FROM range(60)""")
    profiles = spark.createDataFrame([("o", "B", None, "s", "w", 3)], "org_id string, business_name string, industry string, core_services string, what_they_dont_do string, team_size int")
    orgs = spark.createDataFrame([("o",), ("x",)], "org_id string")
    whole = {r.org_id: r.context for r in context.snapshots(orgs, profiles, facts).collect()}
    assert whole["x"] == context.NO_PROFILE
    assert whole["o"].startswith("Business: B\nIndustry: None\nCore services: s\nWhat they don't do: w\nTeam size: 3\n\n== Known facts ==\n[Belief] n59: c\n[Belief] n57: c")
    lines = whole["o"].split("== Known facts ==\n")[1].split("\n")
    assert lines == [f"[{t}] n{i}: c" for t, odd in (("Belief", 1), ("Client", 0)) for i in range(59, -1, -1) if i % 2 == odd]


def test_snapshot_without_facts(spark):
    facts = spark.createDataFrame([], "id bigint, org_id string, entity_type string, name string, content string, superseded_at timestamp, created_at timestamp")
    profiles = spark.createDataFrame([("o", "B", "i", "s", "w", 3)], "org_id string, business_name string, industry string, core_services string, what_they_dont_do string, team_size int")
    assert context.snapshots(profiles.select("org_id"), profiles, facts).first().context.endswith("== Known facts ==\n" + context.NO_FACTS)


def test_least_after_in_time_linear_in_the_rows(spark):
    """One key of 300,000 rows in one range; every third row has a value."""
    n, before = 300_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        began = time.time()
        rows = spark.range(n).select(F.lit("o").alias("k"), "id", F.when(F.col("id") % 3 == 0, F.col("id") * 2).alias("v"))
        got = range_least_after(rows, ["k"], ["id"], "v", "least")
        wrong = got.filter(~F.col("least").eqNullSafe(F.when(F.col("id") <= n - 3, F.ceil(F.col("id") / 3) * 6)))
        assert got.count() == n and wrong.count() == 0
        assert time.time() - began < 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
