import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from factlake.llm import common
from factlake.llm import pitman_yor as py
from factlake.llm.common import fold
from factlake.llm.queries import op1_pitman_yor
from factlake.session import fresh_path

SMALL = "/root/testdata/sf0.01"


def test_query(spark):
    docs = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = Counter(w for i, words in docs.items() if not held[i] for w in words)
    n, v = sum(counts.values()), len(counts)
    rows = op1_pitman_yor(spark, SMALL).collect()
    assert len(rows) == len(docs)
    sums = np.zeros((2, 3))
    for r in rows:
        words = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), n)
        assert r.n_known == sum(counts[w] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert math.isfinite(r.score) and r.score < 0
        sums[int(r.held_out)] += r.base_score, r.score, r.n_tokens
    print(10 ** (-sums[:, :2] / sums[:, 2:]))
    assert sums[1, 1] > sums[1, 0]
    assert sums[:, 1].sum() > sums[:, 0].sum()
    again = {r.doc_id: r.score for r in op1_pitman_yor(spark, SMALL).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in rows)


def _model(spark, counts):
    words = spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, n long")
    return py.learn(words)


def test_probabilities_add_up(spark):
    counts = {b"": 40, b"the": 300, b"a": 90, b"cat": 1, b"tea": 2, b"eat": 5, "été".encode(): 3}
    model = _model(spark, counts)
    p = 10 ** py.log10_p(model, list(counts), np.array(list(counts.values())))
    assert p.sum() + 10 ** py.log10_unknown(model) == pytest.approx(1, abs=1e-6)
    assert p[1] == pytest.approx(300 / 442, abs=0.05)
    # All words of up to two bytes have most of what spelling gives.
    short = [b""] + [bytes([a]) for a in range(256) if a != 32] + [bytes([a, b]) for a in range(256) for b in range(256) if 32 not in (a, b)]
    word, cells = py.letters(short)
    assert 0 < py._spelled(model.samples[0], word, cells, len(short)).sum() < 1
    for sample in model.samples:
        assert np.exp(sample.shares).sum(axis=1) == pytest.approx(1, abs=1e-4)


def test_seating_follows_the_process():
    """Mean tables of single seating, of grouped seating, and of a plain simulation."""
    rng = np.random.default_rng(0)
    for c, a, d in ((1, 5.0, 0.5), (2, 0.3, 0.6), (20, 2.0, 0.5), (1000, 4.0, 0.4), (5000, 40.0, 0.7)):
        keys = py.mix(np.arange(1, 2001, dtype=np.uint64))
        got = py.seat(np.full(2000, c), np.full(2000, a), d, keys, 3)
        plain = []
        for _ in range(200):
            t = 1
            for i, u in enumerate(rng.random(c - 1), 1):
                t += u < a / (a + i - d * t)
            plain.append(t)
        assert got.min() >= 1 and got.max() <= c
        assert got.mean() == pytest.approx(np.mean(plain), rel=0.05)
    assert py.seat(np.array([0, 1]), np.ones(2), 0.5, np.ones(2, dtype=np.uint64), 0).tolist() == [0, 1]


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "A a\tB"), (3, "A a\tB"), (None, "x " * 3000), (4, "é zz zzz")]
    df = spark.createDataFrame([(*r, 1.0, 5) for r in rows], "doc_id long, text string, score double, block long")
    got = py.score(df, "doc_id", "text", fold("doc_id", 7) == 2).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_tokens == by_id[2].n_tokens == 1 and by_id[3].n_tokens == 4 and by_id[None].n_tokens == 3001
    assert py.score(df.filter("false"), "doc_id", "text", fold("doc_id", 7) == 2).count() == 0
    untaught = py.score(df, "doc_id", "text", fold("doc_id", 7) >= 0).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in untaught)
    names = py.perplexity(py.score(df, "doc_id", "text", fold("doc_id", 7) == 2)).columns
    assert names == ["held_out", "perplexity", "base_perplexity"]


def test_order_of_words_counts(spark):
    """Shuffled texts score less; probabilities after each word add up, also after one never seen."""
    rng = np.random.default_rng(5)
    chain = {i: rng.permutation(40)[:3] for i in range(40)}
    texts = []
    for _ in range(300):
        at = [int(rng.integers(40))]
        for _ in range(30):
            at.append(int(rng.choice(chain[at[-1]])))
        texts.append([f"w{i}" for i in at])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, " ".join(rng.permutation(t))) for i, t in enumerate(texts[:100])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in py.score(df, "doc_id", "text", py.F.col("doc_id").between(0, 99) | (py.F.col("doc_id") >= 1000)).collect()}
    assert all(got[i].base_score == pytest.approx(got[1000 + i].base_score) for i in range(100))
    assert np.mean([got[i].score - got[1000 + i].score for i in range(100)]) > 10

    docs = df.filter("doc_id >= 100 AND doc_id < 1000")
    words, pairs = py.count_words(docs, "text"), py.count_pairs(docs, "text", 3)
    model, state = py.learn_pairs(words, pairs)
    state = state.orderBy("word").collect()
    counts = Counter()
    for t in texts[100:]:
        counts.update(zip(["", *t], [*t, ""], strict=True))
    found = [bytes(r.word) for r in state]
    keys = py._keys(found)
    states = range(py.BURN_IN, py.BURN_IN + py.SAMPLES + 1)
    p = np.array([[r[f"p{i}"] for r in state] for i in states])
    unknown = np.array([py._unknown(model, s) for s in model.samples])
    assert p[1:].sum(axis=1) + unknown == pytest.approx(1, abs=1e-6)
    for r, key in zip(state, keys, strict=True):
        n = np.array([counts[bytes(r.word).decode(), w.decode()] for w in found])
        assert n.sum() == r.n
        t = np.array([[r[f"t{i}"]] * len(found) for i in states])
        total = 10 ** py.log10_pairs(model, n, py.pair_keys(np.full(len(found), key), keys), np.full(len(found), r.n), t, p)
        back = np.mean([(py.THETA + model.pair_discount * t[i, 0]) * u / (py.THETA + r.n) for i, u in enumerate(unknown, 1)])
        assert total.sum() + back == pytest.approx(1, abs=1e-6)


def test_disk_stays_small(spark, monkeypatch):
    """All tables that the query ever writes, those removed again included, stay below eight times its input."""
    written = []
    for module in (py, common):
        monkeypatch.setattr(module, "fresh_path", lambda spark, name: written.append(fresh_path(spark, name)) or written[-1])
    monkeypatch.setattr(py, "discard", lambda spark, path: None)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert py.score(docs, "doc_id", "text", fold("doc_id", 7) == 2).count() == docs.count()
    size = sum(f.stat().st_size for path in written for f in Path(path.removeprefix("file:")).rglob("*.parquet"))
    given = sum(f.stat().st_size for f in [Path(f"{SMALL}/documents.parquet"), *Path(SMALL).glob("documents.parquet/*.parquet")] if f.is_file())
    print(size / given)
    assert 0 < size < 8 * given


def test_score_is_the_models(spark, monkeypatch):
    """Scores by blocks and chunks against the probabilities of all pairs in one place."""
    monkeypatch.setattr(py, "BLOCK_TOKENS", 700)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in np.minimum(rng.zipf(1.3, 40), 200)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    held = {i for i in range(150) if i % 5 == 0}
    got = {r.doc_id: r for r in py.score(df, "doc_id", "text", py.F.col("doc_id") % 5 == 0).collect()}
    docs = df.filter("doc_id % 5 <> 0")
    model, state = py.learn_pairs(py.count_words(docs, "text"), py.count_pairs(docs, "text", -(-150 * 41 // 700)))
    rows = {bytes(r.word): r for r in state.collect()}
    counts = Counter()
    for i, text in enumerate(texts):
        if i not in held:
            counts.update(zip(["", *text.split()], [*text.split(), ""], strict=True))
    states = range(py.BURN_IN, py.BURN_IN + py.SAMPLES + 1)
    unknown = [0.0, *(py._unknown(model, s) for s in model.samples)]
    for i, text in enumerate(texts):
        total = 0.0
        for u, w in zip(["", *text.split()], [*text.split(), ""], strict=True):
            a, b = rows.get(u.encode()), rows.get(w.encode())
            key = py.pair_keys(py._keys([u.encode()]), py._keys([w.encode()]))
            t = np.array([[a[f"t{s}"] if a else 0.0] for s in states])
            p = np.array([[b[f"p{s}"] if b else x] for s, x in zip(states, unknown, strict=True)])
            total += py.log10_pairs(model, np.array([counts[u, w]]), key, np.array([a.n if a else 0]), t, p)[0]
        assert got[i].score == pytest.approx(total, rel=1e-9)
