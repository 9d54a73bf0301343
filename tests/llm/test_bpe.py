import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from factlake.llm import bpe
from factlake.llm.queries import op4_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _ranks():
    with open(PATH, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.codec(PATH, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(library, own, text):
    ids = own.encode(text).tolist()
    assert ids == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, "aab" * 5_000 + "!" * 3_000, "\n" * 4_000 + "x", "é" * 5_000,
                                  "<|endoftext|> in the text", "The the  the\t\r\nthe's 12345678", "日本語のテキスト" * 300])
def test_long_pieces(library, own, text):
    assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_queue_order():
    queue = bpe.RankQueue(50_000)
    entries = [(7, 3), (49_999, 1), (7, 1), (4_096, 0), (64, 5), (0, 9), (7, 2)]
    for rank, position in entries:
        queue.push(rank, position)
    out = []
    while (entry := queue.pop()) is not None:
        out.append(entry)
    assert out == sorted(entries)
    assert queue.top == 0 and not any(queue.low) and not any(queue.mid)


def test_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "a b", "z"), (2, "a b", "z"), (None, "\x00 é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.round_trip(df, ["doc_id"], "text", PATH, public_tokenizers.PATTERN).collect()}
    empty, ab = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"a b").hexdigest()
    assert {(1, 0, empty), (2, 0, empty), (2, 2, ab)} <= got and len(got) == 4
    none = bpe.encode(df.filter("false"), ["doc_id"], "text", PATH, public_tokenizers.PATTERN)
    assert none.count() == 0
    assert none.columns == ["doc_id", "ids"]


def test_query(spark, library):
    small = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op4_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
