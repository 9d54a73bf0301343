import numpy as np
import pytest

from factlake.llm import prefix_forest as pf
from factlake.llm.queries import op2_prefix_forest


def brute(rows, queries, k=10):
    ids = np.array([r[0] for r in rows])
    vectors = np.array([r[1] for r in rows], dtype=float)
    out = {}
    for name, q in queries:
        far = np.sqrt(((vectors - np.array(q, dtype=float)) ** 2).sum(axis=1))
        keep = ids != name
        order = np.lexsort((ids[keep], far[keep]))[:k]
        out[name] = [(i, d) for i, d in zip(ids[keep][order].tolist(), far[keep][order].tolist())]
    return out


@pytest.mark.parametrize("copies", [1, 4])
def test_recall(spark, folder, copies):
    """Also on a table four times as large, whose further rows lie near the given ones."""
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    noise = np.random.default_rng(5).normal(0, 0.08, (copies, len(given), len(given[0][1]))).astype(np.float32)
    noise[0] = 0
    rows = [(i + at * 100_003, (np.float32(v) + step).tolist()) for at, some in enumerate(noise) for (i, v), step in zip(given, some, strict=True)]
    table = f"{folder}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(table)
    want = brute(rows, [r for r in rows if r[0] % 100 == 0])
    got = {}
    for r in op2_prefix_forest(spark, folder).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want)
    hits = 0
    for name, found in got.items():
        assert sorted(found) == list(range(1, 11))
        listed = [found[i] for i in sorted(found)]
        assert listed == sorted(listed, key=lambda x: (x[1], x[0]))
        exact = dict(want[name])
        hits += len(exact.keys() & {v for v, _ in listed})
        assert all(exact.get(v, s) == pytest.approx(s) for v, s in listed)
    print(hits / 10 / len(want))
    assert hits >= 0.9 * 10 * len(want)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (100, [0.0, 2.0]), (100, [0.0, 2.0]), (200, None), (None, [1.0, 1.0]), (8, [1.0]), (9, []), (10, [-3.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, shard int")
    got = {}
    for r in pf.nearest(df.filter("vec_id % 100 = 0"), df, "vec_id", "embedding", share=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 6)))
    assert sorted(got) == [0, 100]
    assert sorted(got[0])[:3] == [(1, 1, 0.0), (2, 2, 0.0), (3, 100, round(5 ** 0.5, 6))]
    assert {v for _, v, _ in got[100]} == {0, 1, 2, 10}
    assert pf.nearest(df.filter("false"), df, "vec_id", "embedding").count() == 0
    assert pf.nearest(df, df.filter("false"), "vec_id", "embedding").count() == 0


def test_share_of_one_is_exact_and_shards_merge(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(500)] + [(1000 + i, [0.5] * 8) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, [r for r in rows if r[0] % 100 == 0])
    got = {}
    for r in pf.nearest(df.filter("vec_id % 100 = 0"), df, "vec_id", "embedding", share=1.0, shard_rows=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}


def test_descent_and_ascent():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 6))
    planes = pf.Planes(vectors, trees=5)
    forest = pf.Forest(planes, vectors)
    strings = planes.strings(vectors)
    query = rng.normal(size=(20, 6))
    for q, found in zip(planes.strings(query).T, forest.candidates(query, 0.2)):
        common = pf._common(strings, q[:, None])
        depth = next(d for d in range(64, -1, -1) if (common >= d).any(axis=0).sum() >= 80)
        assert found.tolist() == np.flatnonzero((common >= depth).any(axis=0)).tolist()


@pytest.mark.parametrize("n", [2, 8, 12, 20])
def test_small_tables_give_k_rows(spark, n):
    """With the default share, all others of a small table or k of them, however many rows a query has itself."""
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(n)] + [(0, rng.normal(size=8).tolist())] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame(rows[:n], df.schema)
    got = pf.nearest(asked, df, "vec_id", "embedding").groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {i: min(10, n - 1 if i == 0 else n + 2) for i in range(n)}
