"""Cross-tokenizer alignment by pointer jumping.

Two tokenizers cut the same bytes. Every token points to the token of the other
side that overlaps it and reaches farthest to the right, or to itself if none
reaches farther; of two that end together the one of the first side stays.
Doubling all pointers at once, until none moves, brings each token to the last
token of its component: the token before a place where both sides cut. So
tokens with the same last token are one group.

Both tokenizers cut at a single space after a character that is not white space,
whatever stands around it (``Side.cuts_at_spaces`` says if that holds for a
vocabulary; if not, texts stay whole). So a text is a sequence of segments, a
block of texts has each segment encoded and aligned once, and no text is too
long. A block is written to the shared folder as one row: segment numbers of
each text, and the linked id pairs of each segment. Pairs are counted over all
blocks by a grouped sum; each block then gets the counts of its own pairs by a
join and adds them up per text.

Defined cases: a text that is null, empty or whose tokens of either side don't
join to the same bytes has no tokens: all its numbers are 0, its digest is empty
and it adds nothing to the counts. Equal texts count once each; rows with a
repeated or null id stay rows of their own. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BLOCK_BYTES = 8 << 20
WINDOW = 1 << 20
ENCODED_AT_ONCE = 1 << 17
JOINED_AT_ONCE = 1 << 16
RESULTS = ("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
_CUT = re.compile(r"(?<=\S) ")


class Side:
    """A vocabulary: the bytes of each id, end to end, and how to encode texts with it."""

    cuts_at_spaces = False

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        n = self.sizes[ids]
        return self.flat[np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a space and each text."""
        raise NotImplementedError


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel(Side):
    """A byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        back, vocabulary = byte_characters(), self.model.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        super().__init__(pieces)
        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        split = own.get("pre_tokenizer") or {}
        self.cuts_at_spaces = split.get("type") == "ByteLevel" and bool(split.get("use_regex", True)) and not own.get("normalizer")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        made = self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype=np.int64) for e in made]


class Pieces(Side):
    """A ``sentencepiece`` model, which adds the space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        as_byte = re.compile(r"<0x([0-9A-F]{2})>")
        super().__init__([bytes([int(m[1], 16)]) if (m := as_byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in names])
        self.cuts_at_spaces = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.int64) for ids in self.model.encode(texts, num_threads=1)]


def last_of_group(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token, by its number on the first side, of each token's group; both sides end together."""
    n = len(ends_a)
    over_a, over_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    farther = ends_b[over_a] > ends_a if n else np.zeros(0, dtype=bool)
    points_to = np.concatenate([np.where(farther, n + over_a, np.arange(n)), over_b])
    while True:
        jumped = points_to[points_to]
        if np.array_equal(jumped, points_to):
            return points_to[:n], points_to[n:]
        points_to = jumped


@dataclass
class Aligned:
    """Segments of one run: numbers, group strings and linked pairs, whose number per segment is ``n_links``."""

    counts: np.ndarray
    strings: list[str]
    pairs: np.ndarray
    fine: np.ndarray


class Aligner:
    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.splits = a.cuts_at_spaces and b.cuts_at_spaces
        names = [str(i) for i in range(max(len(a.sizes), len(b.sizes)))]
        # An id with what follows it: another of its side, the other side, the next group, nothing.
        self.written = np.array([n + mark for mark in (",", "|", ";", "") for n in names], dtype=object)
        self.width = len(names)

    def segments(self, text: str) -> Iterator[list[str]]:
        """The text in windows of segments, each to be encoded with a space in front."""
        if not self.splits:
            yield [text]
            return
        # White space at the end stays with the segment before it.
        at, end = 0, len(text.rstrip())
        while end - at > WINDOW:
            cut = _CUT.search(text, at + WINDOW, end)
            if cut is None:
                break
            yield _CUT.split(text[at:cut.start()])
            at = cut.end()
        rest = _CUT.split(text[at:end])
        rest[-1] += text[end:]
        yield rest

    def align(self, segments: list[str]) -> Aligned:
        """All given segments, most of them encoded many at once."""
        parts, together, size = [], [], 0
        order: list[int] = []
        for i, s in enumerate(segments):
            # White space at the end of a text is cut otherwise than before more text.
            if not self.splits or s[-1].isspace():
                parts.append(self._run([s], self.a.encode([s])[0], self.b.encode([s])[0]))
                order.append(i)
                continue
            together.append(i)
            size += len(s) + 1
            if size >= ENCODED_AT_ONCE:
                parts.append(self._many([segments[j] for j in together]))
                order += together
                together, size = [], 0
        if together:
            parts.append(self._many([segments[j] for j in together]))
            order += together
        n_links = np.concatenate([p.counts[:, 3] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        back = np.argsort(np.array(order, dtype=np.int64))
        strings = [s for p in parts for s in p.strings]
        pairs = np.concatenate([p.pairs for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        starts, n = np.cumsum(n_links) - n_links, n_links[back] if parts else n_links
        pick = np.repeat(starts[back] - (np.cumsum(n) - n), n) + np.arange(n.sum()) if parts else np.zeros(0, dtype=np.int64)
        return Aligned(np.concatenate([p.counts for p in parts])[back] if parts else np.zeros((0, 4), dtype=np.int64),
                       [strings[i] for i in back], pairs[pick],
                       np.concatenate([p.fine for p in parts])[back] if parts else np.zeros(0, dtype=bool))

    def _many(self, segments: list[str]) -> Aligned:
        text = " ".join(segments)
        done = self._run(segments, self.a.encode([text])[0], self.b.encode([text])[0])
        if done.fine.all() or len(segments) == 1:
            return done
        # Something in here doesn't come back byte by byte: find out which segments.
        each = [self._run([s], a, b) for s, a, b in zip(segments, self.a.encode(segments), self.b.encode(segments), strict=True)]
        return Aligned(np.concatenate([e.counts for e in each]), [e.strings[0] for e in each],
                       np.concatenate([e.pairs for e in each]), np.concatenate([e.fine for e in each]))

    def _run(self, segments: list[str], a: np.ndarray, b: np.ndarray) -> Aligned:
        raw = [s.encode() for s in segments]
        whole = b"".join(b" " + r for r in raw)
        closes = np.cumsum([len(r) + 1 for r in raw])
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        if (self.a.joined(a) != whole or self.b.joined(b) != whole
                or not np.isin(closes, ends_a).all() or not np.isin(closes, ends_b).all()):
            n = len(segments)
            return Aligned(np.zeros((n, 4), dtype=np.int64), [""] * n, np.zeros(0, dtype=np.int64), np.zeros(n, dtype=bool))
        last_a, last_b = last_of_group(ends_a, ends_b)
        is_last = last_a == np.arange(len(a))
        group = np.cumsum(is_last) - 1
        of_a, of_b = group[last_a], group[last_b]
        # Segments by the ends of their tokens.
        own_a, own_b = np.searchsorted(closes, ends_a), np.searchsorted(closes, ends_b)
        n = len(segments)
        first = np.searchsorted(ends_b, ends_a - self.a.sizes[a], "right")
        links = np.searchsorted(ends_b, ends_a) - first + 1
        n_links = np.bincount(own_a, links, n).astype(np.int64)
        counts = np.stack([np.bincount(own_a, minlength=n), np.bincount(own_b, minlength=n), np.bincount(own_a, is_last, n).astype(np.int64), n_links], axis=1)
        left = np.repeat(np.arange(len(a)), links)
        right = np.repeat(first - (np.cumsum(links) - links), links) + np.arange(links.sum())
        # Groups lie one after another, in each the first side's ids and then the second's.
        mark_a = np.where(is_last, 1, 0)
        closing = np.append(of_b[1:] != of_b[:-1], True)
        mark_b = np.where(closing, np.where(np.isin(ends_b, closes), 3, 2), 0)
        place_a = np.arange(len(a)) + np.searchsorted(of_b, of_a, "left")
        place_b = np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")
        line = np.empty(len(a) + len(b), dtype=object)
        line[place_a], line[place_b] = self.written[mark_a * self.width + a], self.written[mark_b * self.width + b]
        words, cuts = line.tolist(), np.cumsum(counts[:, 0] + counts[:, 1]).tolist()
        strings = ["".join(words[i:j]) for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]
        return Aligned(counts, strings, a[left] << 32 | b[right], np.ones(n, dtype=bool))


def _pack(values: np.ndarray, dtype: str) -> bytes:
    raw = values.astype(dtype).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpack(packed: bytes, dtype: str) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], n, codec="zstd", asbytes=True) if n else b"", dtype=dtype)


def _sums(values: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """Sums of runs of whole numbers; ``values`` may have columns."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.int64), np.cumsum(values, axis=0, dtype=np.int64)])
    ends = np.cumsum(per_row)
    return total[ends] - total[ends - per_row]


class Block:
    """Texts whose segments are encoded together."""

    def __init__(self, aligner: Aligner, texts: list[str | None]):
        index: dict[str, int] = {}
        coded: list[np.ndarray] = []
        for text in texts:
            runs = [np.array([index.setdefault(s, len(index)) for s in window], dtype=np.int64)
                    for window in aligner.segments(text)] if text else []
            coded.append(np.concatenate(runs) if runs else np.zeros(0, dtype=np.int64))
        done = aligner.align(list(index))
        coded = [c if done.fine[c].all() else c[:0] for c in coded]
        self.per_text = np.array([len(c) for c in coded], dtype=np.int64)
        self.codes = np.concatenate(coded) if coded else np.zeros(0, dtype=np.int64)
        self.numbers = _sums(done.counts[self.codes], self.per_text)
        self.digests = [self._digest(done.strings, c) for c in coded]
        used = np.bincount(self.codes, minlength=len(index))
        self.per_segment = done.counts[:, 3]
        self.pairs, self.which = np.unique(done.pairs, return_inverse=True)
        self.times = np.bincount(self.which, np.repeat(used, self.per_segment), len(self.pairs)).astype(np.int64)

    @staticmethod
    def _digest(strings: list[str], codes: np.ndarray) -> str:
        if not len(codes):
            return ""
        digest = hashlib.sha256()
        for at in range(0, len(codes), JOINED_AT_ONCE):
            line = ";".join([strings[c] for c in codes[at:at + JOINED_AT_ONCE].tolist()])
            digest.update((";" + line if at else line).encode())
        return digest.hexdigest()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_level: str, pieces: str) -> Aligner:
    """The aligner of a worker, read once from files that every machine has."""
    if (byte_level, pieces) not in _ALIGNERS:
        _ALIGNERS[byte_level, pieces] = Aligner(ByteLevel(byte_level), Pieces(pieces))
    return _ALIGNERS[byte_level, pieces]


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.Table]:
    """Rows, text last, in runs of about ``block_bytes`` of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0), dtype=np.int64))])
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes - size, "right")) - 1)
            held.append(batch.slice(at, stop - at))
            size += int(offsets[stop] - offsets[at])
            at = stop
            if size >= block_bytes or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def align(docs: DataFrame, keep: list[str], text: str, byte_level: str, pieces: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns with the numbers of ``RESULTS``: tokens of both sides, groups, links, and how common its links are."""
    made = [part.split()[0] for part in RESULTS.split(", ")]
    if clash := set(keep) & set(made):
        raise ValueError(f"kept columns with the name of a result: {sorted(clash)}")
    # Kept columns go by their place, so that no name of theirs can meet one in here.
    kept = docs.select(*[F.col(f"`{name}`").alias(f"k{i}") for i, name in enumerate(keep)], F.col(f"`{text}`").alias("t"))
    inner = "".join(f"k{i}: {kept.schema[i].dataType.simpleString()}, " for i in range(len(keep)))
    numbers = "n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = aligner(byte_level, pieces), TaskContext.get().partitionId()
        for number, table in enumerate(_blocks(batches, block_bytes)):
            block = Block(own, table.column("t").to_pylist())
            columns = {f"k{i}": table.column(i).combine_chunks() for i in range(len(keep))}
            columns |= {name: pa.array(block.numbers[:, i]) for i, name in enumerate(made[:4])}
            columns["groups_sha256"] = pa.array(block.digests, pa.string())
            rows = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([part << 32 | number]),
                "texts": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                "codes": [_pack(block.codes, "<u4")], "per_text": [_pack(block.per_text, "<u4")],
                "which": [_pack(block.which, "<u4")], "per_segment": [_pack(block.per_segment, "<u4")],
                "pairs": pa.array([block.pairs], pa.list_(pa.int64())), "times": pa.array([block.times], pa.list_(pa.int64()))})

    blocks = stored(kept.mapInArrow(encoded, f"block bigint, texts array<struct<{inner}{numbers}>>, codes binary, per_text binary, "
                                             "which binary, per_segment binary, pairs array<bigint>, times array<bigint>"), "token-blocks")
    asked = blocks.select("block", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("block", "p.pairs", "p.times")
    totals = asked.groupBy("pairs").agg(F.sum("times").alias("count")).filter("count > 0")
    by_b = F.col("pairs").bitwiseAND(0xFFFFFFFF)
    # A vocabulary bounds the pairs of one id.
    top = totals.groupBy(by_b.alias("b")).agg(F.max("count").alias("top"))
    marked = totals.withColumn("b", by_b).join(top, "b").select("pairs", "count", (F.col("count") == F.col("top")).alias("best"))
    answers = asked.select(F.col("block").alias("at"), "pairs").join(marked, "pairs", "left").select("at", "pairs", "count", "best")

    def counted(block: pa.Table, answer: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(answer["pairs"]))
        count = np.asarray(answer["count"].fill_null(0))[order]
        best = np.asarray(answer["best"].fill_null(False)).astype(np.int64)[order]
        row = {name: block[name][0].as_py() for name in ("codes", "per_text", "which", "per_segment")}
        which, per_segment = _unpack(row["which"], "<u4"), _unpack(row["per_segment"], "<u4").astype(np.int64)
        of_segment = _sums(np.stack([best[which], count[which]], axis=1), per_segment)
        sums = _sums(of_segment[_unpack(row["codes"], "<u4")], _unpack(row["per_text"], "<u4").astype(np.int64))
        texts = block["texts"].combine_chunks().flatten()
        columns = [texts.field(i) for i in range(len(keep) + 4)] + [pa.array(sums[:, 0]), pa.array(sums[:, 1]), texts.field(len(keep) + 4)]
        return pa.Table.from_arrays(columns, names=[f"k{i}" for i in range(len(keep))] + made)

    found = (blocks.select("block", "texts", "codes", "per_text", "which", "per_segment").groupBy("block")
             .cogroup(answers.groupBy("at")).applyInArrow(counted, inner.replace(":", "") + RESULTS))
    return found.toDF(*keep, *made)
