import zlib

import numpy as np
import pyarrow as pa
import pytest

from factlake.llm import common, toxicity
from factlake.llm.queries import op9_toxicity

SF = "/root/testdata/sf0.1"


def test_query(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op9_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    counts = np.zeros((2, 2), dtype=int)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.held_out and r.doc_id in labels:
            counts[labels[r.doc_id], r.predicted] += 1
    assert counts[1, 1] >= 0.85 * counts[1].sum(), counts
    assert counts[0, 1] <= 0.03 * counts[0].sum(), counts


def test_cases(spark):
    rng = np.random.default_rng(3)
    docs = []
    for i in range(80):
        words = [f"w{n}" for n in rng.integers(0, 40, 12)] + (["idiot", "scum"] if i % 2 else ["nice", "day"]) * 2
        docs.append((i, " ".join(rng.permutation(words)), 0.5, "s"))
    docs += [(100, None, 0.1, "s"), (101, "", 0.1, None), (102, " \t\n", 0.1, "s"), (103, "idiot", 0.1, "s"), (103, "idiot", 0.1, "s"), (None, "nice day", 0.1, "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double, mark string")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(80)] + [(3, 0, "x"), (5, None, "x"), (None, 1, "x"), (999, 1, "x")],
                                   "doc_id long, toxic int, text string")
    model = toxicity.learn(df, labels, "doc_id", "text", "toxic")
    got = toxicity.score(df, ["doc_id"], "text", model).collect()
    assert len(got) == len(docs)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].predicted == 1 and by_id[103].predicted == 1 and by_id[2].predicted == 0 and by_id[None].predicted == 0
    assert by_id[100].score == by_id[101].score == by_id[102].score
    assert toxicity.score(df.filter("false"), ["doc_id"], "text", model).count() == 0
    for none, share in ((labels.filter("false"), 0.0), (labels.filter("toxic = 1"), 1.0)):
        assert {r.score for r in toxicity.score(df, ["doc_id"], "text", toxicity.learn(df, none, "doc_id", "text", "toxic")).collect()} == {share}


def test_words_of_any_text():
    texts = ["The the\tTHE\x0b\x0cx", None, "", " ", "é É nbsp word", "a " * 700_000 + "b" * 1_500_000 + " c", "z", "y" * 3_000_000]
    got = {}
    for first, per_row, words in common.word_hashes(pa.array(texts)):
        ends = np.cumsum(per_row)
        for i, (n, end) in enumerate(zip(per_row, ends)):
            got[first + i] = words[end - n:end].tolist()
    seen = {}
    for i, text in enumerate(texts):
        own = (text or "").encode().lower().split()
        assert len(got[i]) == len(own)
        for w, h in zip(own, got[i]):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_models_are_distributions():
    rng = np.random.default_rng(1)
    names = common.mix(np.arange(1, 40, dtype=np.uint64))
    own = rng.integers(1, 9, (2, len(names))).astype(float)
    own[0, 0] = 30
    model = toxicity.fit(names, own, own.max(axis=0) + 1, 0.75)
    assert len(model.words.keys) == len(names), "every word is named here"
    assert model.words.get(names, (0, 0)).sum(axis=1) == pytest.approx(1, abs=0.02)
    gain = model.word_differences(np.concatenate([names[:1], common.mix(np.arange(900, 903, dtype=np.uint64))]))
    assert gain[0] > 0 and not gain[1:].any(), "unknown words say nothing"
