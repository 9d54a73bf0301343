import numpy as np
import pytest

from factlake.llm import minhash_forest as mf
from factlake.llm.components import components
from factlake.llm.queries import op5_minhash_forest


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Exact groups from an inverted index; rows of (id, text)."""
    sets = [(i, shingles(t)) for i, t in rows]
    classes = {}
    for i, s in sets:
        if s and i is not None:
            classes.setdefault(s, []).append(i)
    listed, index, up = list(classes), {}, {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, s in enumerate(listed):
        shared = {}
        for w in s:
            for b in index.get(w, ()):
                shared[b] = shared.get(b, 0) + 1
            index.setdefault(w, []).append(a)
        for b, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(listed[b]) - n):
                up[find(a)] = find(b)
    smallest = {}
    for a, s in enumerate(listed):
        smallest[find(a)] = min(smallest.get(find(a), 1 << 62), min(classes[s]))
    at = {s: smallest[find(a)] for a, s in enumerate(listed)}
    return sorted(((i, len(s), at.get(s, i) if i is not None else None) for i, s in sets), key=repr)


def made(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    assert made(op5_minhash_forest(spark, f"/root/testdata/{sf}")) == brute(rows)


def _corpus(seed, groups, size, words=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(groups):
        base = rng.choice(vocabulary, words).tolist()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.integers(0, 5)):
                own[rng.integers(0, words)] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(own)))
    return rows


def test_large_groups_are_cut(spark):
    rows = _corpus(1, 2, 150) + [(1000 + i, t) for i, t in _corpus(2, 30, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert made(mf.near_duplicates(df, "doc_id", "text")) == want
    assert made(mf.near_duplicates(df, "doc_id", "text", chunk=16)) == want


def test_cases(spark):
    rows = [(5, "a b c"), (3, "A B\tC"), (9, "a b c d"), (4, None), (6, ""), (7, " \n"), (8, "one two three four five"), (None, "one two three four five"),
            (8, "one two three four five"), (2, "é é é é é é"), (10, "É é é é é é"), (11, "x " * 50), (12, "x " * 9)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n long, class string")
    assert made(mf.near_duplicates(df, "doc_id", "text")) == brute(rows)
    assert mf.near_duplicates(df.filter("false"), "doc_id", "text").count() == 0
    assert mf.near_duplicates(df.filter("doc_id = 4"), "doc_id", "text").count() == 1


def test_components(spark):
    rng = np.random.default_rng(4)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    other = [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (220, 2))]
    edges = chain + star + other + [(5, 5)]
    rng.shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame([tuple(map(int, e)) for e in edges], "a long, b long")).collect()))
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {n: find(n) for n in up if n in got}
    assert set(got) >= {int(n) for a, b in edges if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
