import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from factlake.llm import token_align as ta
from factlake.llm.queries import op12_token_align

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Plain:
    """Whole texts through the libraries, tokens by sets of their bytes."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        # The rule of byte-level vocabularies, as tables print it.
        self.byte = {}
        extra = 256
        for n in range(256):
            if chr(n).isprintable() and n not in (32, 173) and (n < 127 or n > 160):
                self.byte[chr(n)] = n
            else:
                self.byte[chr(extra)] = n
                extra += 1

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def spans(self, ids, of):
        at, out = 0, []
        for i in ids:
            n = len(of(i))
            out.append((i, at, at + n))
            at += n
        return out

    def one(self, text):
        if not text:
            return None
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        of_a = lambda i: bytes(self.byte[c] for c in self.a.id_to_token(i))
        whole = (" " + text).encode()
        if b"".join(map(of_a, a)) != whole or b"".join(map(self.bytes_b, b)) != whole:
            return None
        a, b = self.spans(a, of_a), self.spans(b, self.bytes_b)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, links = [], []
        parts = [[[] for _ in cuts] for _ in range(2)]
        for part, side in zip(parts, (a, b), strict=True):
            for t in side:
                part[bisect.bisect_left(cuts, t[2])].append(t)
        for ga, gb in zip(*parts, strict=True):
            groups.append(",".join(str(t[0]) for t in ga) + "|" + ",".join(str(t[0]) for t in gb))
            links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
        return len(a), len(b), groups, links

    def all(self, texts):
        done = [self.one(t) for t in texts]
        count = Counter(p for d in done if d for p in d[3])
        top = {}
        for (_, b), n in count.items():
            top[b] = max(top.get(b, 0), n)
        rows = []
        for d in done:
            if d is None:
                rows.append((0, 0, 0, 0, 0, 0, ""))
                continue
            rows.append((d[0], d[1], len(d[2]), len(d[3]), sum(count[p] == top[p[1]] for p in d[3]), sum(count[p] for p in d[3]),
                         hashlib.sha256(";".join(d[2]).encode()).hexdigest()))
        return rows


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  ", "a\n", "\n a b\n\n", "a  b   c", "foo\n bar baz", "x\ty z", "café naïve 日本語 \U0001f600",
       "▁a b", "<|endoftext|> <s> </s> <unk> <0x41>", "don't we'll I'd", "a b c", "a  b", "12345 67 8", "é x", "\x00 \x1c b",
       "① ﬁn", "y" * 5000, "ab " * 3000, "�?", "foo bar", "foo bar"]


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {d.doc_id: r for d, r in zip(docs, Plain().all([d.text for d in docs]), strict=True)}
    got = op12_token_align(spark, SF)
    assert got.columns == ["doc_id", *NAMES]
    rows = got.collect()
    assert len(rows) == len(docs) and sum(r.n_links for r in rows) > 10_000
    assert {r.doc_id: tuple(r[n] for n in NAMES) for r in rows} == want


@pytest.mark.parametrize("block_bytes", [1, 3000, 1 << 23])
def test_cases(spark, block_bytes):
    want = Plain().all(ODD)
    df = spark.createDataFrame([(i if i % 5 else None, t, "x", i, [i]) for i, t in enumerate(ODD)],
                               "doc_id long, text string, block string, pairs long, `k0` array<int>")
    got = ta.align(df, ["pairs", "doc_id", "block", "k0"], "text", A, B, block_bytes).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert tuple(r[n] for n in NAMES) == want[r.pairs], ODD[r.pairs]
        assert r.block == "x" and r.k0 == [r.pairs] and r.doc_id == (r.pairs if r.pairs % 5 else None)
    assert ta.align(df.filter("false"), ["doc_id"], "text", A, B).count() == 0
    with pytest.raises(ValueError):
        ta.align(df.withColumnRenamed("block", "n_a"), ["n_a"], "text", A, B)


def test_segments_are_exact(monkeypatch):
    """Encoding by segments, in any window, gives what whole texts give; so does a vocabulary that can't be split."""
    monkeypatch.setattr(ta, "WINDOW", 40)
    monkeypatch.setattr(ta, "ENCODED_AT_ONCE", 60)
    rng = random.Random(4)
    parts = ["a", "Foo", " ", "  ", "\n", "'s", "9", "é", "▁", "　", "-", "the", "\t", ".", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    own = ta.Aligner(ta.ByteLevel(A), ta.Pieces(B))
    assert own.splits
    split = ta.Block(own, texts)
    own.splits = False
    whole = ta.Block(own, texts)
    assert split.digests == whole.digests and (split.numbers == whole.numbers).all()
    assert (split.pairs[split.times > 0] == whole.pairs[whole.times > 0]).all() and (split.times[split.times > 0] == whole.times[whole.times > 0]).all()


def test_pointers_meet_at_common_ends():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 4000):
        ends = [np.append(np.flatnonzero(rng.random(n) < p) + 1, n + 1) for p in (0.4, 0.05)]
        cuts = np.intersect1d(*ends)
        for last, own in zip(ta.last_of_group(*ends), ends, strict=True):
            assert (ends[0][last] == cuts[np.searchsorted(cuts, own)]).all()
    none = np.zeros(0, dtype=np.int64)
    assert [len(x) for x in ta.last_of_group(none, none)] == [0, 0]
