import random
import itertools
import re

import pytest

from factlake.llm import mixing
from factlake.llm.queries import op7_mixing

SMALL = "/root/testdata/sf0.01"


def test_shares():
    assert mixing.shares({"a": 60, "b": 60}) == pytest.approx({"a": 40, "b": 80})
    # c would get 60 of 120 but holds 4, the rest is shared again.
    got = mixing.shares({"a": 56, "b": 60, "c": 4})
    assert got == pytest.approx({"a": 36, "b": 72, "c": 12})
    got = mixing.shares({None: 10, "b": 1, "\U0001F600": 5, "a": 2})
    assert list(sorted(got, key=lambda s: (s is None, s or ""))) == ["a", "b", "\U0001F600", None]
    assert sum(got.values()) == pytest.approx(18)
    assert got["b"] == 3
    assert mixing.shares({}) == {} and mixing.shares({"a": 0}) == {"a": 0.0}


def _cost(amount, held, repeats):
    return sum(r * r * max(0, min(amount - r * held, held)) for r in range(repeats))


@pytest.mark.parametrize("patterns,quotas", [
    ({("a",): 3, ("a", "b"): 2, ("b",): 1}, {"a": 6, "b": 4}),
    ({("a",): 2, ("a", "b"): 3}, {"a": 2, "b": 7}),
    ({("a", "b"): 2, ("b", None): 2}, {"a": 3, "b": 2, None: 3}),
    ({("a",): 0, ("b",): 2}, {"a": 4, "b": 9}),
])
def test_flow_is_cheapest(patterns, quotas):
    got = mixing.flow(patterns, quotas)
    routes = [(p, s) for p in patterns for s in p]
    best = None
    for amounts in itertools.product(*[range(min(3 * patterns[p], quotas[s]) + 1) for p, s in routes]):
        out = {p: sum(a for (q, _), a in zip(routes, amounts) if q == p) for p in patterns}
        into = {s: sum(a for (_, t), a in zip(routes, amounts) if s == t) for s in quotas}
        if all(out[p] <= 3 * patterns[p] for p in patterns) and all(into[s] <= quotas[s] for s in quotas):
            key = (-sum(amounts), sum(_cost(out[p], patterns[p], 3) for p in patterns))
            best = key if best is None else min(best, key)
    assert best == (-sum(sum(v.values()) for v in got.values()),
                    sum(_cost(sum(got[p].values()), patterns[p], 3) for p in patterns))


def test_query(spark):
    rows = op7_mixing(spark, SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in docs.items()}
    by_source = {}
    for i, d in docs.items():
        by_source[d.source] = by_source.get(d.source, 0) + sizes[i]
    targets = mixing.shares(by_source)
    taken = {}
    assert len(rows) == len(docs)
    for r in rows:
        source = docs[r.doc_id].source
        assert (r.size, r.source_size) == (sizes[r.doc_id], by_source[source])
        assert r.target == pytest.approx(targets[source])
        assert r.taken in {0, r.size, 2 * r.size, 3 * r.size}
        taken[source] = taken.get(source, 0) + r.taken
    longest = max(sizes.values())
    for source, target in targets.items():
        assert abs(taken[source] - target) <= longest / 2 + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op7_mixing(spark, SMALL).collect()))


def test_cases(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, None, None), (3, "", "t"), (4, "x\ty\x0bz", None), (None, "q " * 50, "s"), (5, "m", "t")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, mixed string, size int")
    got = mixing.report(df, "doc_id", "text", "source").collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == [0, 0, 1, 2, 2, 3, 50]
    assert all(r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size for r in got)
    mixed = mixing.mixture(df, "doc_id", "text", "source")
    assert mixed.columns == df.columns
    assert mixing.report(df.filter("false"), "doc_id", "text", "source").count() == 0
    assert mixing.mixture(df.filter("false"), "doc_id", "text", "source").count() == 0


def test_overlapping_sources(spark):
    df = spark.range(3000).selectExpr("id", "10 AS words", "CASE WHEN id % 3 = 0 THEN array('a', 'b') WHEN id % 3 = 1 THEN array('a') ELSE array() END AS held")
    got = mixing.pick(df, "id", df.words.cast("bigint"), df.held).collect()
    times = {}
    for r in got:
        times.setdefault(r.id % 3, []).append(r.mix_times)
    # 30,000 words in memberships: a takes 10,000 and b, which only the shared documents hold, 20,000.
    assert sum(times[0]) == 2000 and sum(times[1]) == 1000 and sum(times[2]) == 0


def test_rows_that_share_an_id_are_picked_alike_in_any_order(spark):
    rows = [(1, " ".join(["w"] * n), "a" if n % 2 else "b", n) for n in range(1, 40)]
    seen = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, cut long").repartition(1 + seed)
        seen.add(tuple(sorted(r.cut for r in mixing.mixture(df, "doc_id", "text", "source").collect())))
    assert len(seen) == 1


def test_sources_without_shared_documents_need_no_network(monkeypatch):
    patterns = {("a",): 10, ("b",): 4, ("c", "d"): 9, ("c",): 3}
    quotas = {"a": 17, "b": 50, "c": 9, "d": 30}
    whole = mixing.flow(patterns, quotas)
    asked = []
    monkeypatch.setattr(mixing, "flow", lambda p, q, r, own=mixing.flow: asked.append(p) or own(p, q, r))
    parts = mixing.routed(patterns, quotas)
    assert list(asked[0]) == [("c", "d"), ("c",)]
    for source in quotas:
        assert sum(p.get(source, 0) for p in parts.values()) == sum(p.get(source, 0) for p in whole.values())
    assert parts["a",] == {"a": 17} and parts["b",] == {"b": 12}
