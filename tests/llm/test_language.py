import zlib

import numpy as np
import pytest

from factlake.llm import language
from factlake.llm.queries import op8_language


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_language(spark, sf).collect()
    assert len(rows) == len(docs)
    right = {True: [], False: []}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        right[r.held_out].append(r.lang_pred == docs[r.doc_id].lang)
    assert np.mean(right[True]) > 0.97
    again = {(r.doc_id, r.lang_pred, r.score) for r in op8_language(spark, sf).collect()}
    assert again == {(r.doc_id, r.lang_pred, r.score) for r in rows}


def test_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ... \n", "de"), (4, "the cat and the dog", "en"), (4, "the cat and the dog", "en"),
            (5, "der Hund und die Katze", "de"), (6, "el perro y la gata", "es"), (7, "mot", None), (None, "der und", "de"), (8, "x", "tlh"),
            (9, "le chien et le chat sont dans la maison", "fr")]
    df = spark.createDataFrame([(*r, 0.5, "s") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    model = language.learn(df, "doc_id", "text", "lang")
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"], "tlh": ["tlh"]}
    got = {(r.doc_id, r.lang_pred) for r in language.predict(df, ["doc_id"], "text", model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (6, "es"), (8, "tlh"), (9, "fr")} <= got
    empty = language.learn(df.filter("false"), "doc_id", "text", "lang")
    assert {(r.lang_pred, r.score) for r in language.predict(df, ["doc_id"], "text", empty).collect()} == {("und", 0.0)}
    assert language.predict(df.filter("false"), ["doc_id"], "text", model).count() == 0
    only = language.fit([("the cat", "en")])
    assert only.predict(language.margins(only, ["anything"])[0]) == ("en", 1.0)


@pytest.mark.parametrize("size", [1, 5000, language.SLICE - 4, language.SLICE, 3 * language.SLICE + 17])
def test_slices_change_nothing(size):
    rng = np.random.default_rng(size)
    text = "".join(rng.choice(list("abc é\nñ"), size))
    model = language.Model({"a": ["x"], "b": ["y"]}, {}, rng.normal(size=(2, language.CELLS)).astype(np.float32), np.array([0.5, -1]))
    want = features = language.features(text) @ model.weights.T + model.bias
    together = language.margins(model, ["ab", text, "zz", text])
    assert np.allclose(together[1], want) and np.allclose(together[3], features)
    assert np.allclose(together[0], language.features("ab") @ model.weights.T + model.bias)
