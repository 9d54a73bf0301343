import hashlib

import numpy as np
import pyarrow as pa
import pytest

from factlake.llm import fingerprint as fp
from factlake.llm.queries import op10_fingerprint

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("shared,left,right", [(0, 0, 0), (5, 0, 0), (50, 1, 0), (40, 3, 4), (0, 30, 1), (1000, 200, 170), (3, 0, 500)])
def test_peeling_recovers_the_difference(shared, left, right):
    rng = np.random.default_rng(shared + left)
    keys = np.unique(rng.integers(0, 1 << 63, shared + left + right).astype(np.uint64))
    rng.shuffle(keys)
    a, b = fp.Printed(""), fp.Printed("")
    a.keys, b.keys = np.sort(keys[:shared + left]), np.sort(np.concatenate([keys[:shared], keys[shared + left:]]))
    found = a.difference(b)
    assert set(found[0].tolist()) == set(keys[shared:shared + left].tolist())
    assert set(found[1].tolist()) == set(keys[shared + left:].tolist())
    if left + right > 40:
        assert fp.peel(fp.subtract(fp.sketch(a.keys), fp.sketch(b.keys))) is None


def test_many_pairs_at_once():
    """Whatever sizes lie side by side, each pair's difference is exact; so is peeling one pair with a sketch that is large enough."""
    rng = np.random.default_rng(5)
    pairs = []
    for i in range(300):
        both, left, right = rng.integers(0, (300, 1 + i, 40))
        keys = np.unique(rng.integers(0, 1 << 63, both + left + right).astype(np.uint64))
        rng.shuffle(keys)
        pairs.append((np.sort(keys[:both + left]), np.sort(np.concatenate([keys[:both], keys[both + left:]]))))
    for (a, b), (mine, its) in zip(pairs, fp.differences(pairs), strict=True):
        assert np.sort(mine).tolist() == np.setdiff1d(a, b).tolist() and np.sort(its).tolist() == np.setdiff1d(b, a).tolist()
    alone = fp.peel(fp.subtract(fp.sketch(pairs[9][0], 12 * 4 ** 5), fp.sketch(pairs[9][1], 12 * 4 ** 5)))
    assert np.sort(alone[0]).tolist() == np.setdiff1d(*pairs[9]).tolist()
    assert fp.differences([]) == []


def test_query(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()), reverse=True)
    rows = {r.doc_id: r for r in op10_fingerprint(spark, SMALL).collect()}
    assert len(rows) == len(docs)
    prints = {}
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        r = rows[i]
        changed = fp.edited(text, after)
        a, b, c = (set(fp.digests(t).tolist()) for t in (text, changed, after))
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx(len(a & b) / max(1, len(a | b)) if a | b else 1.0)
        assert r.near_next == pytest.approx(len(a & c) / max(1, len(a | c)) if a | c else 1.0)
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert r.edited_fingerprint == fp.Printed(changed).fingerprint()
    assert len(set(prints.values())) == len(prints)


def _pairs(df, n):
    def made(rows):
        return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.string()),
                         "c": pa.array([r[2] for r in rows], pa.string())})
    return sorted(map(tuple, fp.neighbours(df, "doc_id", "text", made, "a bigint, b string, c string", n).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("rows", [
    [(i * 7 % 31 - 9, f"t{i}") for i in range(31)],
    [(1, "x"), (1, "x"), (1, "y"), (None, "n"), (None, None), (3, None), (2, ""), (-5, "m"), (1, "z")],
    [(4, "only")], [(None, "a"), (None, "b")], [],
])
def test_next_document(spark, rows, n):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = [(r[0], r[1] or "", after[1] or "") for r, after in zip(order, order[1:] + order[:1])]
    assert _pairs(df, n) == sorted(want, key=repr)


def test_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "a b\na b\na b")], "doc_id long, text string")
    got = {r.doc_id: r for r in fp.compare_edits(df, "doc_id", "text").collect()}
    assert got[1].n_chars == got[2].n_chars == 0
    assert got[1].fingerprint == got[2].fingerprint == got[3].fingerprint != got[4].fingerprint
    assert got[2].near_next == 1.0 and got[4].near_next == 0.0 and got[1].near_edited == 1.0
    assert got[4].fingerprint.startswith("3:")
