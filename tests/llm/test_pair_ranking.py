import zlib

import numpy as np
import pyarrow as pa
import pytest

from factlake.llm import pair_ranking as pr
from factlake.llm.queries import op11_pair_ranking

SF = "/root/testdata/sf0.1"


def test_query(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op11_pair_ranking(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    counts = np.zeros((2, 2), dtype=int)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.held_out and r.doc_id in labels:
            counts[labels[r.doc_id], r.predicted] += 1
    assert counts[0, 0] >= 0.95 * counts[0].sum(), counts
    assert counts[1, 1] >= 0.97 * counts[1].sum(), counts


def test_cases(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "delta", "house", "river", "stone"]
    docs = []
    for i in range(120):
        line = " ".join(rng.choice(words, 30))
        docs.append((i, line.capitalize() + "." if i % 2 else line.replace(" ", "### ").upper() + "###", 0.5, "s"))
    docs += [(200, None, 0.1, "s"), (201, "", 0.1, None), (202, " \t\n", 0.1, "s"), (7, "River### STONE###", 0.1, "s"),
             (None, "Stone river house.", 0.1, "s"), (203, "x" * 5_000_000, 0.1, "s"), (204, "### " * 900_000, 0.1, "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double, mark string")
    marks = [(i, i % 2, "x") for i in range(120)] + [(3, 0, "x"), (5, None, "x"), (None, 1, "x"), (999, 1, "x"), (7, 1, "x")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, text string")
    model = pr.learn(df, labels, "doc_id", "text", "quality")
    again = pr.learn(df.repartition(5), labels.repartition(3), "doc_id", "text", "quality")
    assert np.allclose(model.weights, again.weights) and model.cut == pytest.approx(again.cut), "the order of rows decides nothing"
    got = pr.score(df, ["doc_id", "mark"], "text", model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 120 and r.doc_id != 7)
    by_id = {r.doc_id: r for r in got}
    assert by_id[200].score == by_id[201].score
    assert pr.score(df.filter("false"), ["doc_id"], "text", model).count() == 0
    with pytest.raises(ValueError):
        pr.score(df, ["score"], "text", model)
    for none, share in ((labels.filter("false"), 0.0), (labels.filter("quality = 1"), 1.0)):
        scored = pr.score(df, ["doc_id"], "text", pr.learn(df, none, "doc_id", "text", "quality"))
        assert {r.score for r in scored.collect()} == {share}


def by_hand(text):
    raw = (text or "").encode()
    low, cap = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = [low, cap, b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b";:!?'\"()-"]
    of = [next((k for k, some in enumerate(kinds) if b in some), 9 if b > 127 else 8) for b in raw]
    words = raw.lower().split() if text else []
    n, size = len(words), len(raw)
    threes = [tuple(words[i:i + 3]) for i in range(n - 2)]
    length = sum(map(len, words)) / max(1, n)
    letters = sum(k in (0, 1, 9) for k in of)
    return [*[of.count(k) / max(1, size) for k in range(10)], np.log1p(size), np.log1p(length), np.exp(-length),
            sum(a in (0, 1, 9) and b == 8 for a, b in zip(of, of[1:])) / max(1, n), sum(a == b == 1 for a, b in zip(of, of[1:])) / max(1, letters),
            np.log1p(n / (of.count(5) + 1)), np.log1p(n / (of.count(4) + 1)), len(set(words)) / max(1, n),
            len(set(threes)) / max(1, len(threes)), sum(a == b for a, b in zip(words, words[1:])) / max(1, n)]


def test_features_by_hand(monkeypatch):
    texts = ["One two two, THREE.\nfour###", None, "", " \n", "é É über; 12 AB", "A", "#A", "one two three one two three one", "x" * 700 + " YY" * 300, "Z#"]
    want = np.array([by_hand(t) for t in texts])
    assert len(pr.NAMES) == want.shape[1]
    for size in (1 << 20, 64, 7):
        monkeypatch.setattr(pr, "SLICE_BYTES", size)
        assert np.allclose(pr.features(pa.array(texts)), want)
        assert np.allclose(pr.features(pa.array(["first", *texts]).slice(1)), want)


def test_weights_find_the_better():
    """Against plain gradient descent, and on strengths that are known."""
    rng = np.random.default_rng(1)
    x, true = rng.normal(size=(600, 3)), np.array([2.0, -1.0, 0.0])
    a, b = rng.integers(0, 600, (2, 6000))
    wins = rng.random(6000) < 1 / (1 + np.exp(-(x[a] - x[b]) @ true))
    d = np.where(wins[:, None], x[a] - x[b], x[b] - x[a])
    w = pr.bradley_terry(d)
    assert np.abs(w - true).max() < 0.2
    plain = np.zeros(3)
    for _ in range(3000):
        plain -= 2e-4 * (pr.RIDGE * plain - d.T @ (1 / (1 + np.exp(d @ plain))))
    assert np.abs(w - plain).max() < 1e-3
    winners, losers = pr.pairs(np.arange(5), np.arange(100, 103), 4)
    assert np.bincount(winners, minlength=5).tolist() == [4] * 5 and set(losers) == {100, 101, 102}


def test_quantile():
    s, high = np.array([1.0, 2.0, 3.0, 4.0]), np.array([0, 0, 1, 1])
    assert pr.best_quantile(s, high) == 0.5
    assert pr.best_quantile(s, np.array([0, 1, 1, 1])) == 0.25
    assert 0 <= pr.best_quantile(s, np.ones(4)) <= 1
    assert [pr.cut_at(s, q) for q in (0.0, 0.25, 0.5, 1.0)] == [0.5, 1.5, 2.5, 4.5]


@pytest.mark.parametrize("rare", [60, 700])
def test_every_labelled_row_teaches(spark, monkeypatch, rare):
    """Cells hold all rows of the common label once; the sums over cells are those of their pairs; the cut is that of one process."""
    monkeypatch.setattr(pr, "CELL", 200)
    rng = np.random.default_rng(5)
    n = 5000
    x, mark = rng.normal(size=(n, len(pr.NAMES))), np.r_[np.zeros(rare, dtype=int), np.ones(n - rare, dtype=int)]
    x[mark == 0, 0] -= 2
    rows = spark.createDataFrame([(int(m), i % 4 == 0, i, v.tolist()) for i, (m, v) in enumerate(zip(mark, x))], "mark int, later boolean, id bigint, x array<double>")
    cells = pr.celled(rows, n - rare, rare).collect()
    seen = [r.id for c in cells for r in c.rows]
    assert len(cells) > 10 and set(seen) == set(range(n)), "no labelled row is left out"
    assert sorted(i for i in seen if mark[i]) == list(range(rare, n))
    assert all({r.mark for r in c.rows} == {0, 1} for c in cells)
    model = pr.Model(x.mean(axis=0), x.std(axis=0), np.zeros(0))
    w = rng.normal(size=2 * len(pr.NAMES)) / 10
    got = pr.cells_sums(pr.celled(rows, n - rare, rare), model)(w)
    want = [0.0, 0.0, 0.0]
    for c in cells:
        z, m = pr._expanded(np.array([r.x for r in c.rows]), model.middle, model.spread), np.array([r.mark for r in c.rows])
        a, b = pr.pairs(np.flatnonzero(m > 0), np.flatnonzero(m == 0), seed=pr.SEED + c.cell)
        want = [s + t for s, t in zip(want, pr.pair_sums(z[a] - z[b], w))]
    assert all(np.allclose(s, t) for s, t in zip(got, want))
    s = np.round(x[:, 0], 1)
    strengths = spark.createDataFrame([(int(m), i, float(v)) for i, (m, v) in enumerate(zip(mark, s))], "mark int, id bigint, strength double")
    assert pr.best_cut(strengths, rare, n - rare) == pytest.approx(pr.cut_at(s, pr.best_quantile(s, mark)))


def test_fit_uses_more_rows_than_any_sample(spark):
    """9,000 labelled rows, of which no 2,000 a label hold the whole loss."""
    seen = []
    docs = spark.range(9000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('### ', 20) ELSE concat('Plain words of text ', id, '.') END AS text")
    labels = spark.range(9000).selectExpr("id AS doc_id", "CAST(id % 3 > 0 AS INT) AS quality")
    fit = pr.fit
    try:
        pr.fit = lambda rows, *_: seen.append(rows.count() if hasattr(rows, "count") else len(rows)) or fit(rows, *_)
        pr.learn(docs, labels, "doc_id", "text", "quality")
    finally:
        pr.fit = fit
    assert seen == [9000]
