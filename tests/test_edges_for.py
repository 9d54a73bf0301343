"""First edges of many questions: against plain Python, and in memory that the number of questions doesn't move."""

from factlake.operators import graph


def tables(spark, questions):
    edges = spark.createDataFrame([(i % 7, 10 + i % 5, f"r{i % 3}") for i in range(60)], "from_id bigint, to_id bigint, relationship_type string")
    nodes = spark.createDataFrame([(i, "o" if i % 2 else "p", "Client", f"n{i}", f"c{i}") for i in range(16)],
                                  "entity_id bigint, org_id string, entity_type string, name string, content string")
    facts = spark.createDataFrame([(i, i) for i in range(16)], "id bigint, source_id bigint")
    sources = spark.createDataFrame([(i, f"C{i % 3}", i % 3 > 0) for i in range(16)], "id bigint, channel_id string, channel_is_private boolean")
    members = spark.createDataFrame([("o", "C1", "u"), ("o", "C1", "u"), ("p", "C2", "u"), ("o", "C2", "v")], "org_id string, channel_id string, user_id string")
    return questions, edges, nodes, facts, sources, members


def test_questions_of_one_user_and_of_one_id(spark):
    rows = [(1, "o", "u"), (2, "o", "u"), (3, "o", None), (4, "o", "v"), (5, "p", "u"), (6, None, "u"), (7, "o", "u"), (7, "p", "u"), (8, "o", "v"), (8, "o", "v"), (None, "o", "u")]
    given = tables(spark, spark.createDataFrame(rows, "query_id bigint, org_id string, user_id string"))
    got = [tuple(r) for r in graph.list_edges_for(*given, limit=9).select("query_id", "rank", "from_name", "to_name", "relationship").collect()]
    sees = {("o", "u"): {"C1"}, ("p", "u"): {"C2"}, ("o", "v"): {"C2"}}
    edges = sorted((i % 7, 10 + i % 5, f"r{i % 3}") for i in range(60))
    want = []
    for query in {r[0] for r in rows}:
        seen = sorted(e for q, org, user in rows if q == query for e in edges
                      if ("o" if e[0] % 2 else "p") == org and (e[0] % 3 == 0 or f"C{e[0] % 3}" in sees.get((org, user), ())))
        want += [(query, i + 1, f"n{e[0]}", f"n{e[1]}", e[2]) for i, e in enumerate(seen[:9])]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_task_sorts_what_all_questions_see(spark):
    questions = spark.range(100_000).selectExpr("id AS query_id", "'o' AS org_id", "'u' AS user_id")
    df = graph.list_edges_for(*tables(spark, questions), limit=15)
    store, context = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext

    def stages():
        listed = store.stageList(None, False, False, context._gateway.new_array(context._gateway.jvm.double, 0), None)
        return {listed.apply(i).stageId(): listed.apply(i).peakExecutionMemory() / max(1, listed.apply(i).numTasks()) for i in range(listed.size())}

    before = stages()
    assert df.groupBy().count().first()[0] == 1_500_000
    df.write.format("noop").mode("overwrite").save()
    used = max(mb for stage, mb in stages().items() if stage not in before) / (1 << 20)
    assert used < 200, used
