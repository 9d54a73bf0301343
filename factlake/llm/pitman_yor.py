"""Language-model scoring with a hierarchical Pitman-Yor model.

The model is nested: each preceding word has a restaurant, whose new tables order
their dish from one restaurant of all words; new tables there order it from a
spelling model; the spelling model is a hierarchy of
restaurants, one for each context of two bytes, with the one-byte contexts and
then the empty context as shared parents, and all 256 bytes alike at the root.
A table opened anywhere is a customer of the parent, so a rare word takes part
of its probability from how it is spelt, and a rare spelling from shorter
contexts. As in the base score, all words that training has not seen are one
outcome: its probability is what a new table gives to their spellings together.
The first word and the end of a text have the end before them, an end the last word.
A word that training has not seen has an empty restaurant, which gives the parent's
probabilities.

Seating is sampled by Gibbs sweeps over blocks: all customers of a dish in one
restaurant are seated anew, one after another, given all other restaurants. The
``i``-th customer opens a table with probability ``a / (a + i - d * t)``, where
``a`` is the strength ``theta + d * (tables in the restaurant)`` times the
parent's probability and ``t`` counts the dish's tables; beyond ``SINGLY``
customers they arrive in groups of an eighth of those seated. Only ``t`` matters for
the predictions. The chance is a hash of dish, restaurant and sweep, so every
machine draws the same. Predictive probabilities are averaged over
the samples after the burn-in, and a text's score is the sum of their logs.

Texts are read once and kept as chunks: the distinct words of about a million tokens and
the places of the tokens among them. Words are packed in parts by ranges of their 64-bit hash, pairs in a
square grid of blocks by the ranges of both words, so a common word's pairs are spread over a row or a column;
pairs are told apart by the hashes of their words. A pair seen once has one table in every sweep, so these
are added up once. A sweep sends the words of the other pairs to their blocks, seats these, and sends the new
tables back to the words. Each block answers each chunk in the order in which the chunk named its pairs. The spelling
model has at most 65,536 contexts of 256 bytes, however large the corpus, and is the only thing that is collected and broadcast.

Tokens are words with A-Z lower-cased and one end per text, which is the empty word.

Defined cases: a null text is an empty one, of just the end; with nothing to
learn from all bytes are alike; repeated rows are texts of their own; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import _hash_slice, discard, mix

BURN_IN, SAMPLES = 1, 3
THETA = 1.0
LETTER_DISCOUNT, LETTER_THETA = 0.5, 1.0
SINGLY = 32
CHUNK_TOKENS, BLOCK_TOKENS = 1_000_000, 2_000_000
END = b""
END_KEY = 0x5851F42D4C957F2D
_SALT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def uniform(keys: np.ndarray, sweep: int, step: int) -> np.ndarray:
    """Numbers from 0 to 1, the same on every machine."""
    with np.errstate(over="ignore"):
        salt = np.uint64(((sweep * 1009 + step) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        return (mix(keys ^ salt) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def seat(customers: np.ndarray, a: np.ndarray, d: float, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish after all its customers were seated anew."""
    tables = np.minimum(customers, 1).astype(np.float64)
    some = np.flatnonzero(customers > 1)
    for i in range(1, SINGLY):
        some = some[customers[some] > i]
        if not len(some):
            return tables
        strength = a[some]
        tables[some] += uniform(keys[some], sweep, i) < strength / (strength + i - d * tables[some])
    seated, step = SINGLY, SINGLY
    some = some[customers[some] > seated]
    while len(some):
        group = np.minimum(customers[some] - seated, seated // 8)
        strength = a[some]
        share = strength / (strength + seated + group / 2 - d * tables[some])
        tables[some] += np.floor(group * share + uniform(keys[some], sweep, step))
        seated, step = seated + seated // 8, step + 1
        some = some[customers[some] > seated]
    return tables


class Spelling:
    """Restaurants of two-byte contexts over one-byte contexts over the empty one."""

    def __init__(self, cells: np.ndarray, customers: np.ndarray):
        """``cells`` are ``context * 256 + byte`` with their ``customers``."""
        self.cells, self.customers = cells, customers
        self.context, self.byte = cells >> 8, cells & 255
        parent = np.unique(cells & 0xFFFF)
        self.parents, self.of_parent = parent, np.searchsorted(parent, cells & 0xFFFF)
        self.used, self.of_context = np.unique(self.context, return_inverse=True)
        self.p1 = np.full((256, 256), 1 / 256)
        self.tables2 = np.minimum(customers, 1).astype(np.float64)
        self.tables1 = np.ones(len(parent))

    def sweep(self, number: int) -> np.ndarray:
        """One Gibbs sweep from the deepest restaurants to the root; predictive shares of each used context, then by the last byte."""
        d, theta = LETTER_DISCOUNT, LETTER_THETA
        b1, byte1 = self.parents >> 8, self.parents & 255
        held2 = np.bincount(self.of_context, self.tables2, minlength=len(self.used))
        a = (theta + d * held2[self.of_context]) * self.p1[(self.cells >> 8) & 255, self.byte]
        self.tables2 = seat(self.customers, a, d, self.cells.astype(np.uint64), number)
        customers1 = np.bincount(self.of_parent, self.tables2, minlength=len(self.parents))
        p0 = self._root(byte1)
        held1 = np.bincount(b1, self.tables1, minlength=256)
        self.tables1 = seat(customers1, (theta + d * held1[b1]) * p0[byte1], d, self.parents.astype(np.uint64) + np.uint64(1 << 40), number)
        p0 = self._root(byte1)
        total1, held1 = np.bincount(b1, customers1, minlength=256), np.bincount(b1, self.tables1, minlength=256)
        p1 = np.outer((theta + d * held1) / (theta + total1), p0)
        p1[b1, byte1] += (customers1 - d * self.tables1) / (theta + total1[b1])
        self.p1 = p1
        total2 = np.bincount(self.of_context, self.customers, minlength=len(self.used))
        held2 = np.bincount(self.of_context, self.tables2, minlength=len(self.used))
        p2 = ((theta + d * held2) / (theta + total2))[:, None] * p1[self.used & 255]
        p2[self.of_context, self.byte] += (self.customers - d * self.tables2) / (theta + total2[self.of_context])
        return np.concatenate([p2, p1])

    def _root(self, byte1: np.ndarray) -> np.ndarray:
        """The empty context: its customers are the tables of the one-byte contexts, each with a table of its own per byte."""
        customers = np.bincount(byte1, self.tables1, minlength=256)
        kinds = (customers > 0).sum()
        d, theta = LETTER_DISCOUNT, LETTER_THETA
        p = np.maximum(customers - d, 0) + (theta + d * kinds) / 256
        return p / p.sum()


@dataclass
class Sample:
    """One state of the chain, as much of it as predictions need."""

    rows: np.ndarray
    shares: np.ndarray
    tables_before: float
    tables: float
    sweep: int
    known: float = 0.0
    customers: float = 0.0


@dataclass
class Model:
    """``n`` tokens and ``v`` words of training; the samples are those of the restaurant of all words and of spelling."""

    n: int
    v: int
    discount: float
    samples: list[Sample]
    pair_discount: float = 0.5


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the word and cell (context and byte) of each letter and of the end of each word."""
    raw = np.frombuffer(b"  " + b"  ".join(words) + b"  ", dtype=np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(sizes + 2) - sizes
    word = np.repeat(np.arange(len(words)), sizes + 1)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    at = starts[word] + np.arange(len(word)) - first[word]
    return word, raw[at - 2] << 16 | raw[at - 1] << 8 | raw[at]


def _keys(words: list[bytes]) -> np.ndarray:
    """A number for each word."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out = np.full(len(words), END_KEY, dtype=np.uint64)
    out[sizes > 0] = _hash_slice(np.frombuffer(b" ".join(w for w in words if w), dtype=np.uint8), np.zeros(0, dtype=np.int64))[0]
    return out


def _spelled(sample: Sample, word: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
    """Probability of each word's spelling."""
    logs = sample.shares[sample.rows[cells >> 8], cells & 255]
    return np.exp(np.bincount(word, logs, minlength=n))


def _seated(model: Model, sample: Sample, counts: np.ndarray, spelled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return seat(counts, (THETA + model.discount * sample.tables_before) * spelled, model.discount, keys, sample.sweep)


def log10_p(model: Model, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Averaged predictive probability of each word with its count in training, as log10."""
    total = sum(_served(model, sample, words, counts) for sample in model.samples)
    return np.log10(np.maximum(total / len(model.samples), 1e-300))


def _served(model: Model, sample: Sample, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Predictive probability of each word in the restaurant of all words, with its customers there."""
    word, cells = letters(words)
    spelled = _spelled(sample, word, cells, len(words))
    tables = _seated(model, sample, counts, spelled, _keys(words))
    return ((counts - model.discount * tables) + (THETA + model.discount * sample.tables) * spelled) / (THETA + sample.customers)


def _unknown(model: Model, sample: Sample) -> float:
    return (THETA + model.discount * sample.tables) * (1 - sample.known) / (THETA + sample.customers)


def log10_unknown(model: Model) -> float:
    """Averaged probability that the next word is one that training has not seen, as log10."""
    return float(np.log10(np.mean([_unknown(model, s) for s in model.samples])))


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A number for each pair of word numbers."""
    with np.errstate(over="ignore"):
        return mix(before * _SALT ^ words)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each pair; it grows with the pair's number."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Numbers compressed, whole ones from 0 on in the fewest bytes that hold the largest; with their kind, width and size."""
    if values.dtype.kind != "f":
        values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    raw = values.tobytes()
    return values.dtype.str[1:].encode() + len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _raw(packed: bytes) -> bytes:
    size = int.from_bytes(packed[2:10], "little")
    return pa.decompress(packed[10:], size, codec="zstd", asbytes=True) if size else b""


def unpack(packed: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(_raw(packed), dtype=packed[:2].decode()).astype(kind)


def pack_words(words: list[bytes]) -> bytes:
    return pack(np.frombuffer(b" ".join(words), dtype=np.uint8))


def unpack_words(packed: bytes) -> list[bytes]:
    return _raw(packed).split(b" ")


def _batches(rows: Iterator[dict], schema: str) -> Iterator[pa.RecordBatch]:
    """One batch per row, as rows are large; memory that Arrow no longer uses goes back."""
    fields = _fields(schema)
    for row in rows:
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_pylist([row], schema=fields)


def _fields(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(),
             "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _kept(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """The rows written once to the shared folder, and where."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


FINER = 4


def sides(ranges: int) -> int:
    """Rows, and columns, of the least square grid with so many blocks; there are ``FINER`` times as many parts of words."""
    return math.isqrt(max(1, ranges) - 1) + 1


CHUNK = "chunk bigint, docs array<bigint>, held_out array<boolean>, sizes binary, stream binary, words binary"


def chunked(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out`` and ``text`` as rows of about ``CHUNK_TOKENS`` tokens.

    A row has its distinct words by their numbers, and the places among them of all tokens, text after text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        first, made = TaskContext.get().partitionId() << 32, 0
        ids, held, streams, size, place = [], [], [], 0, defaultdict(count().__next__)

        def flush() -> dict:
            found = list(place)
            order = np.argsort(_keys(found), kind="stable")
            rank = np.empty(len(found), dtype=np.int64)
            rank[order] = np.arange(len(found))
            return {"chunk": first + made, "docs": ids, "held_out": held, "sizes": pack(np.array([len(s) for s in streams])),
                    "stream": pack(rank[np.concatenate(streams)]), "words": pack_words([found[i] for i in order])}

        for batch in batches:
            for doc, out, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                streams.append(np.array([*map(place.__getitem__, words_of(text.as_py())), place[END]], dtype=np.int32))
                ids.append(doc.as_py())
                held.append(out.as_py())
                size += len(streams[-1])
                if size >= CHUNK_TOKENS:
                    yield flush()
                    made += 1
                    ids, held, streams, size, place = [], [], [], 0, defaultdict(count().__next__)
        if size:
            yield flush()

    return docs.select("doc_id", "held_out", "text").mapInArrow(lambda batches: _batches(run(batches), CHUNK), CHUNK)


def _unnamed(docs: DataFrame, text: str) -> DataFrame:
    return chunked(docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(False).alias("held_out"), F.col(text).alias("text")))


def _stream(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: its words, the tokens' places among them, the texts' sizes, and the pairs that the tokens end, as numbers.

    Each text ends with an end, which is the word before the next one; the last end is the one before the first text.
    """
    words, stream = unpack_words(row["words"]), unpack(row["stream"])
    return words, stream, unpack(row["sizes"]), np.roll(stream, 1) * len(words) + stream


def _dealt(pairs: np.ndarray, keys: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Places of both words of each distinct pair of a chunk, and the pairs of each block."""
    before, words = np.divmod(pairs, len(keys))
    line = _range_of(keys, FINER * side) // FINER
    block = line[before] * side + line[words]
    order = np.argsort(block, kind="stable")
    names, first = np.unique(block[order], return_index=True)
    return before, words, list(zip(names.tolist(), np.split(order, first[1:]), strict=True))


NAMED = "block int, chunk bigint, before binary, runs binary, words binary, at binary, n binary"
PAIRS = ("block int, side int, chunk bigint, kinds binary, at binary, before binary, u binary, words binary, w binary, n binary, "
         "single_before binary, opened binary, single_words binary, customers binary, once bigint, twice bigint")


def _count_pairs(chunks: DataFrame, side: int) -> DataFrame:
    """Per block a row without ``chunk``: the pairs seen more than once, packed, and the sums of those seen once.

    ``once`` and ``twice`` are the pairs seen so often. Then a row per chunk: whether each pair it named is unseen (0), seen once (1) or
    more often (2), and the places of these last among the block's pairs. A chunk names the pairs of held out texts too.
    """

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in _rows(batches):
            words, _, sizes, pairs = _stream(row)
            codes = np.sort(pairs * 2 + np.repeat(np.array(row["held_out"], dtype=np.int64), sizes))
            pairs = codes >> 1
            first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            n, keys = np.add.reduceat(1 - (codes & 1), first), _keys(words)
            before, after, blocks = _dealt(pairs[first], keys, side)
            for block, part in blocks:
                u = before[part]
                starts = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
                w, at = np.unique(after[part], return_inverse=True)
                yield {"block": block, "chunk": row["chunk"], "before": pack(keys[u[starts]]), "runs": pack(np.diff(np.append(starts, len(u)))),
                       "words": pack(keys[w]), "at": pack(at), "n": pack(n[part])}

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        befores, afters = ([unpack(row[c], np.uint64) for row in rows] for c in ("before", "words"))
        u_names, w_names = np.unique(np.concatenate(befores)), np.unique(np.concatenate(afters))
        codes = [np.repeat(np.searchsorted(u_names, u), unpack(row["runs"])) * len(w_names) + np.searchsorted(w_names, w)[unpack(row["at"])]
                 for row, u, w in zip(rows, befores, afters, strict=True)]
        sizes, codes = np.cumsum([len(c) for c in codes]), np.concatenate(codes)
        order = np.argsort(codes)
        starts = np.append(True, np.diff(codes[order]) != 0)
        first = np.flatnonzero(starts)
        n = np.add.reduceat(np.concatenate([unpack(row["n"]) for row in rows])[order], first)
        u, w = np.divmod(codes[order[first]], len(w_names))
        pair = np.empty(len(codes), dtype=np.int64)
        pair[order] = np.cumsum(starts) - 1
        more, single = n > 1, n == 1
        more_u, at_u = np.unique(u[more], return_inverse=True)
        more_w, at_w = np.unique(w[more], return_inverse=True)
        single_u, opened = np.unique(u[single], return_counts=True)
        single_w, customers = np.unique(w[single], return_counts=True)
        block = rows[0]["block"]
        out = [{"block": block, "side": side, "before": pack(u_names[more_u]), "u": pack(at_u), "words": pack(w_names[more_w]), "w": pack(at_w),
                "n": pack(n[more]), "single_before": pack(u_names[single_u]), "opened": pack(opened), "single_words": pack(w_names[single_w]),
                "customers": pack(customers), "once": int(single.sum()), "twice": int((n == 2).sum())}]
        kinds, place = np.minimum(n, 2)[pair], (np.cumsum(more) - 1)[pair]
        del codes, order, starts, u, w, pair
        for row, kind, at in zip(rows, np.split(kinds, sizes[:-1]), np.split(place, sizes[:-1]), strict=True):
            out.append({"block": block, "side": side, "chunk": row["chunk"], "kinds": pack(kind), "at": pack(at[kind == 2])})
        return pa.Table.from_pylist(out, schema=_fields(PAIRS))

    return chunks.mapInArrow(lambda batches: _batches(named(batches), NAMED), NAMED).groupBy("block").applyInArrow(merge, PAIRS)


def count_pairs(docs: DataFrame, text: str, ranges: int) -> DataFrame:
    """The pairs of all texts, packed in at least ``ranges`` blocks."""
    return _count_pairs(_unnamed(docs, text), sides(ranges))


def _seated_pairs(n: np.ndarray, tables: np.ndarray, p: np.ndarray, discount: float, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of pairs, given those in their restaurants and their words' probability among all words."""
    return seat(n, (THETA + discount * tables) * p, discount, keys, sweep)


PARTIAL, PART = "part int, words binary, n binary", "part int, words binary, n binary, tokens bigint, kinds bigint"


def _parted(words: list[bytes], n: np.ndarray, parts: int) -> Iterator[dict]:
    """Words with their counts, packed by part."""
    part = _range_of(_keys(words), parts)
    order = np.argsort(part, kind="stable")
    names, first = np.unique(part[order], return_index=True)
    for name, at in zip(names.tolist(), np.split(order, first[1:]), strict=True):
        yield {"part": name, "words": pack_words([words[i] for i in at]), "n": pack(n[at])}


def _merged(partial: DataFrame) -> DataFrame:
    """One row per part: its words by their numbers, and counts."""

    def merge(table: pa.Table) -> pa.Table:
        total: Counter[bytes] = Counter()
        for row in table.to_pylist():
            for word, n in zip(unpack_words(row["words"]), unpack(row["n"]).tolist(), strict=True):
                total[word] += n
        words = sorted(total)
        order = np.argsort(_keys(words), kind="stable")
        words = [words[i] for i in order]
        n = np.array([total[w] for w in words], dtype=np.int64)
        return pa.Table.from_pylist([{"part": table["part"][0].as_py(), "words": pack_words(words), "n": pack(n), "tokens": int(n.sum()),
                                      "kinds": len(n)}], schema=_fields(PART))

    return partial.groupBy("part").applyInArrow(merge, PART)


def _count_words(chunks: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in _rows(batches):
            words, stream, sizes, _ = _stream(row)
            n = np.bincount(stream[~np.repeat(np.array(row["held_out"], dtype=bool), sizes)], minlength=len(words))
            seen = np.flatnonzero(n)
            if len(seen):
                yield from _parted([words[i] for i in seen], n[seen], parts)

    return _merged(chunks.mapInArrow(lambda batches: _batches(run(batches), PARTIAL), PARTIAL))


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """``word`` and ``n`` over all texts; the empty word counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield pa.RecordBatch.from_pydict({"word": pa.array(unpack_words(row["words"]), pa.binary()), "n": unpack(row["n"])})

    return _count_words(_unnamed(docs, text), 2).mapInArrow(run, "word binary, n bigint")


def _tables(words: DataFrame, model: Model, sample: Sample | None) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Seats all words and sends their tables to the spelling model.

    Gives the number of tables, the probability of all these words' spellings, and the cells with their customers.
    """
    shared = words.sparkSession.sparkContext.broadcast((model, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sample = shared.value
        parts, size, tables_held, known = [], 0, 0.0, 0.0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            names, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return names, np.bincount(at, np.concatenate([n for _, n in parts]))

        for batch in batches:
            listed, counts = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            if not listed:
                continue
            word, cells = letters(listed)
            tables = np.ones(len(listed))
            if sample is not None:
                spelled = _spelled(sample, word, cells, len(listed))
                known += spelled.sum()
                tables = _seated(model, sample, counts, spelled, _keys(listed))
            tables_held += tables.sum()
            parts.append((cells, tables[word]))
            size += len(cells)
            if size > 1_000_000:
                parts, size = [merged()], 0
        if parts:
            names, n = merged()
            yield pa.RecordBatch.from_pydict({"cell": np.append(names, [-1, -2]), "n": np.append(n, [tables_held, known])})

    rows = words.select("word", "n").mapInArrow(run, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells, n = np.asarray(rows["cell"]), np.asarray(rows["n"])
    order = np.argsort(cells)
    cells, n = cells[order], n[order]
    letter = cells >= 0
    return float(n[cells == -1].sum()), float(n[cells == -2].sum()), cells[letter], n[letter]


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def _totals(words: DataFrame) -> Row:
    return words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"),
                     F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()[0]


def _spelling_sample(tables: float, cells: np.ndarray, customers: np.ndarray, sweep: int, served: float) -> Sample:
    """Spelling seated anew, for a restaurant of all words with so many customers."""
    spelling = Spelling(cells, customers)
    for inner in range(3):
        shares = spelling.sweep(sweep * 3 + inner)
    rows = np.arange(65536) % 256 + len(spelling.used)
    rows[spelling.used] = np.arange(len(spelling.used))
    return Sample(rows.astype(np.int32), np.log(shares).astype(np.float32), tables, tables, sweep, customers=served)


def learn(words: DataFrame) -> Model:
    """Samples seatings of a table of ``word`` and ``n``, all in one restaurant."""
    total = _totals(words)
    model = Model(total.n, total.v, _discount(total.once, total.twice), [])
    tables, _, cells, customers = _tables(words, model, None)
    for sweep in range(BURN_IN + SAMPLES):
        sample = _spelling_sample(tables, cells, customers, sweep, total.n)
        tables, sample.known, cells, customers = _tables(words, model, sample)
        sample.tables = tables
        if sweep >= BURN_IN:
            model.samples.append(sample)
    return model


SAID = "part int, block int, side int, names binary, n binary"
PLACED = "part int, words binary, n binary, opened binary, customers binary"
STATE = ("part int, block int, side int, t binary, customers binary, tables binary, spelled binary, cells binary, weights binary, "
         "held double, known double, served bigint, once bigint, twice bigint")


def _said(block: int, side: int, names: np.ndarray, n: np.ndarray, parts: int) -> Iterator[dict]:
    """What a block tells the parts of its words: tables that opened in their restaurants (side 0), their customers as dishes (side 1)."""
    if not len(names):
        return
    found, first = np.unique(_range_of(names, parts), return_index=True)
    for part, lo, hi in zip(found.tolist(), first, [*first[1:], len(names)], strict=True):
        yield {"part": part, "block": block, "side": side, "names": pack(names[lo:hi]), "n": pack(n[lo:hi].astype(np.int64))}


def _first_said(pairs: DataFrame, seen_once: bool) -> DataFrame:
    """One table for each pair, of those seen once or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in _rows(batches):
            names = [unpack(row[c], np.uint64) for c in (("single_before", "single_words") if seen_once else ("before", "words"))]
            counts = [unpack(row[c]) for c in ("opened", "customers")] if seen_once else [
                np.bincount(unpack(row[c]), minlength=len(x)) for c, x in zip("uw", names, strict=True)]
            for side in (0, 1):
                yield from _said(row["block"], side, names[side], counts[side], FINER * row["side"])

    return pairs.filter("chunk IS NULL").mapInArrow(lambda batches: _batches(run(batches), SAID), SAID)


def _placed(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """The words with the tables and customers that they have by pairs seen once, which no sweep changes."""

    def run(table: pa.Table, said: pa.Table) -> pa.Table:
        out = table.select(["part", "words", "n"]).to_pylist()
        for row in out:
            row["opened"], row["customers"] = map(pack, _added(_keys(unpack_words(row["words"])), said))
        return pa.Table.from_pylist(out, schema=_fields(PLACED))

    return words.groupBy("part").cogroup(_first_said(pairs, True).groupBy("part")).applyInArrow(run, PLACED)


def _added(keys: np.ndarray, said: pa.Table) -> np.ndarray:
    """Sums of what the blocks say of each word, by side."""
    sums = np.zeros((2, len(keys)), dtype=np.int64)
    for i in range(len(said)):
        row = said.slice(i, 1).to_pylist()[0]
        sums[row["side"], np.searchsorted(keys, unpack(row["names"], np.uint64))] += unpack(row["n"])
    return sums


def _turn(placed: DataFrame, said: DataFrame, model: Model, sample: Sample | None) -> DataFrame:
    """A sweep over all words, given the tables of the pairs.

    Gives a row for each part: its words' tables as restaurants, their customers, tables and spelling as dishes, and what goes to the
    spelling model; and rows that answer the blocks that told of words.
    """
    shared = said.sparkSession.sparkContext.broadcast((model.discount, sample))

    def run(table: pa.Table, said: pa.Table) -> pa.Table:
        discount, sample = shared.value
        out: list[dict] = []
        for row in table.to_pylist():
            words = unpack_words(row["words"])
            keys = _keys(words)
            t, customers = _added(keys, said) + [unpack(row["opened"]), unpack(row["customers"])]
            word, cells = letters(words)
            if sample is None:
                # The first seating starts from the shares of the customers.
                tables, spelled, drawn = np.ones(len(words)), np.zeros(len(words)), np.zeros(len(words))
            else:
                spelled = _spelled(sample, word, cells, len(words))
                drawn = tables = _seated(Model(0, 0, discount, []), sample, customers, spelled, keys)
            found, at = np.unique(cells, return_inverse=True)
            drawn = drawn.astype(np.int64)
            out.append({"part": row["part"], "t": pack(t), "customers": pack(customers), "tables": pack(drawn), "spelled": pack(spelled),
                        "cells": pack(found), "weights": pack(np.bincount(at, tables[word]).astype(np.int64)), "held": float(tables.sum()),
                        "known": float(spelled.sum()), "served": int(customers.sum()), "once": int((customers == 1).sum()),
                        "twice": int((customers == 2).sum())})
            for i in range(len(said)):
                asked = said.slice(i, 1).to_pylist()[0]
                at = np.searchsorted(keys, unpack(asked["names"], np.uint64))
                out.append({"part": row["part"], "block": asked["block"], "side": asked["side"], **(
                    {"customers": pack(customers[at]), "tables": pack(drawn[at]), "spelled": pack(spelled[at])} if asked["side"] else {"t": pack(t[at])})})
        return pa.Table.from_pylist(out, schema=_fields(STATE))

    return placed.groupBy("part").cogroup(said.groupBy("part")).applyInArrow(run, STATE)


def _gathered(state: DataFrame) -> tuple[Row, np.ndarray, np.ndarray]:
    """Sums over all words, and the cells of the spelling model with their customers, added up by ranges of contexts."""
    words = state.filter("block IS NULL")
    schema = "slice int, cells binary, weights binary"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in _rows(batches):
            cells, weights = unpack(row["cells"]), unpack(row["weights"])
            names, first = np.unique(cells >> 20, return_index=True)
            for name, c, n in zip(names.tolist(), np.split(cells, first[1:]), np.split(weights, first[1:]), strict=True):
                yield {"slice": name, "cells": pack(c), "weights": pack(n)}

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        cells, at = np.unique(np.concatenate([unpack(r["cells"]) for r in rows]), return_inverse=True)
        n = np.bincount(at, np.concatenate([unpack(r["weights"]) for r in rows])).astype(np.int64)
        return pa.Table.from_pylist([{"slice": rows[0]["slice"], "cells": pack(cells), "weights": pack(n)}], schema=_fields(schema))

    sums = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("held", "known", "served", "once", "twice"))).collect()[0]
    rows = words.select("cells", "weights").mapInArrow(lambda batches: _batches(split(batches), schema), schema).groupBy("slice").applyInArrow(
        add, schema).toArrow().sort_by("slice").to_pylist()
    return sums, *(np.concatenate([np.zeros(0, dtype=np.int64), *(unpack(r[c]) for r in rows)]) for c in ("cells", "weights"))


@dataclass
class State:
    """A stored sweep; the probability of a word is its customers less the discounted tables plus ``back`` times its spelling, over ``total``."""

    df: DataFrame
    path: str
    sweep: int
    discount: float
    back: float
    total: float

    def p(self, row: dict) -> np.ndarray:
        return self.share(unpack(row["customers"]), unpack(row["tables"]), unpack(row["spelled"], np.float64))

    def share(self, customers: np.ndarray, tables: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        return ((customers - self.discount * tables) + self.back * spelled) / self.total

    def scale(self) -> State:
        """What a task needs."""
        return State(None, "", self.sweep, self.discount, self.back, self.total)


def _answered(states: list[State]) -> DataFrame:
    """What the words of each sweep answer to the blocks."""
    rows = [s.df.filter("block IS NOT NULL").select(F.lit(s.sweep).alias("sweep"), "block", "part", "side", "t", "customers", "tables", "spelled") for s in states]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _seatings(row: dict, answers: list[dict], states: list[State], discount: float) -> Iterator[np.ndarray]:
    """Tables of a block's pairs after each sweep."""
    before, words = (unpack(row[c], np.uint64) for c in ("before", "words"))
    u, w, n = (unpack(row[c]) for c in "uwn")
    keys = pair_keys(before[u], words[w])
    for state in states:
        own = sorted((a for a in answers if a["sweep"] == state.sweep), key=lambda a: a["part"])
        t = np.concatenate([np.zeros(0), *(unpack(a["t"]) for a in own if a["side"] == 0)])
        p = np.concatenate([np.zeros(0), *(state.p(a) for a in own if a["side"] == 1)])
        yield _seated_pairs(n, t[u], p[w], discount, keys, state.sweep)


def _seat_pairs(pairs: DataFrame, state: State, discount: float) -> DataFrame:
    """All pairs seen more than once seated anew after a sweep over the words."""
    scale = state.scale()

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        out: list[dict] = []
        for row in table.to_pylist():
            for seated in _seatings(row, found.to_pylist(), [scale], discount):
                for side, names, at in ((0, "before", "u"), (1, "words", "w")):
                    listed = unpack(row[names], np.uint64)
                    out += _said(row["block"], side, listed, np.bincount(unpack(row[at]), seated, minlength=len(listed)), FINER * row["side"])
        return pa.Table.from_pylist(out, schema=_fields(SAID))

    packed = pairs.filter("chunk IS NULL").select("block", "side", "before", "u", "words", "w", "n")
    return packed.groupBy("block").cogroup(_answered([state]).groupBy("block")).applyInArrow(run, SAID)


def _learn_pairs(words: DataFrame, pairs: DataFrame) -> tuple[Model, str, DataFrame, list[State]]:
    """Samples seatings of pairs, of the words that their tables order, and of the spelling of these.

    Gives the model, the placed words with their path, and the states from the last of the burn-in on.
    """
    spark = words.sparkSession
    total = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).collect()[0]
    kinds = pairs.agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).collect()[0]
    model = Model(total.n, total.v, 0.5, [], _discount(kinds.once or 0, kinds.twice or 0))
    folder, placed = _kept(_placed(words, pairs), "lm-placed")
    said, states, sample = _first_said(pairs, False), [], None
    for sweep in range(BURN_IN + SAMPLES + 1):
        if sweep:
            sample = _spelling_sample(held, cells, customers, sweep - 1, 0)  # noqa: F821
        path, df = _kept(_turn(placed, said, model, sample), "lm-state")
        sums, cells, customers = _gathered(df)
        held = sums.held
        if sample is None:
            model.discount = _discount(sums.once, sums.twice)
            states.append(State(df, path, sweep, model.discount, 0.0, float(max(sums.served, 1))))
        else:
            sample.known, sample.tables, sample.customers = sums.known, held, float(sums.served)
            states.append(State(df, path, sweep, model.discount, THETA + model.discount * held, THETA + sums.served))
            if sweep > BURN_IN:
                model.samples.append(sample)
        if len(states) > SAMPLES + 1:
            discard(spark, states.pop(0).path)
        if sweep < BURN_IN + SAMPLES:
            said = _seat_pairs(pairs, states[-1], model.pair_discount)
    return model, folder, placed, states


def _by_part(placed: DataFrame, states: list[State]) -> DataFrame:
    """The words of each part, and their rows of the states."""
    out = placed.select("part", "words", "n")
    for s in states:
        out = out.unionByName(s.df.filter("block IS NULL").select("part", F.lit(s.sweep).alias("sweep"), "t", "customers", "tables", "spelled"),
                              allowMissingColumns=True)
    return out


def _columns(table: pa.Table, states: list[State]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words of a part, their counts, and by state their tables as restaurants and their probabilities."""
    rows = {row["sweep"]: row for row in table.to_pylist()}
    if None not in rows:
        return [], np.zeros(0, dtype=np.int64), np.zeros((len(states), 0), dtype=np.int64), np.zeros((len(states), 0))
    return (unpack_words(rows[None]["words"]), unpack(rows[None]["n"]), np.array([unpack(rows[s.sweep]["t"]) for s in states]),
            np.array([s.p(rows[s.sweep]) for s in states]))


def learn_pairs(words: DataFrame, pairs: DataFrame) -> tuple[Model, DataFrame]:
    """Samples seatings, given a table of ``word`` and ``n`` and packed pairs.

    Gives the model, and the words with ``n``, and with ``t`` and ``p`` after each sweep from the last of the burn-in on.
    """
    parts = FINER * (pairs.agg(F.max("side")).collect()[0][0] or 1)

    def pack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if batch.num_rows:
                yield from _parted(batch.column(0).to_pylist(), np.asarray(batch.column(1)), parts)

    packed = _merged(words.select("word", "n").mapInArrow(lambda batches: _batches(pack_all(batches), PARTIAL), PARTIAL))
    model, _, placed, states = _learn_pairs(packed, pairs)
    scales = [s.scale() for s in states]

    def run(table: pa.Table) -> pa.Table:
        words, n, t, p = _columns(table, scales)
        return pa.table({"word": pa.array(words, pa.binary()), "n": n, **{f"t{s.sweep}": t[i].astype(np.float64) for i, s in enumerate(scales)},
                         **{f"p{s.sweep}": p[i] for i, s in enumerate(scales)}})

    schema = "word binary, n bigint" + "".join(f", {c}{s.sweep} double" for c in "tp" for s in scales)
    return model, _by_part(placed, states).groupBy("part").applyInArrow(run, schema)


def log10_pairs(model: Model, n: np.ndarray, keys: np.ndarray, held: np.ndarray, tables: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Averaged predictive probability of each pair with its count ``n`` in training, as log10.

    ``held`` is the count of the word before; ``tables`` (of its restaurant) and ``p`` (of the word among all words) have a
    row for the state before the first sample and one for each sample.
    """
    seated = sum(_seated_pairs(n, tables[i], p[i], model.pair_discount, keys, s.sweep) for i, s in enumerate(model.samples))
    return _log10_seated(model, n, seated, held, tables[1:], p[1:])


def _log10_seated(model: Model, n: np.ndarray, seated: np.ndarray, held: np.ndarray, tables: Iterable[np.ndarray], p: Iterable[np.ndarray]) -> np.ndarray:
    """The same, given the tables of the pairs added up over the samples."""
    d = model.pair_discount
    total = len(model.samples) * n - d * seated
    for t, share in zip(tables, p, strict=True):
        total = total + (THETA + d * t) * share
    return np.log10(np.maximum(total / (THETA + held) / len(model.samples), 1e-300))


ANSWER = "chunk bigint, of_pairs boolean, place int, a binary, b binary, c binary"


def _pair_answers(pairs: DataFrame, states: list[State], discount: float) -> DataFrame:
    """To each chunk the kinds of the pairs it named in each block, and of those seen more than once the count and the tables over all samples."""
    scales = [s.scale() for s in states]

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(row for row in rows if row["chunk"] is None)
        n, seated = unpack(own["n"]), np.zeros(0, dtype=np.int64)
        if len(n):
            seated = sum(_seatings(own, found.to_pylist(), scales, discount)).astype(np.int64)
        out = []
        for row in rows:
            if row["chunk"] is not None:
                at = unpack(row["at"])
                out.append({"chunk": row["chunk"], "of_pairs": True, "place": row["block"], "a": row["kinds"], "b": pack(n[at]), "c": pack(seated[at])})
        return pa.Table.from_pylist(out, schema=_fields(ANSWER))

    packed = pairs.select("block", "chunk", "kinds", "at", "before", "u", "words", "w", "n")
    return packed.groupBy("block").cogroup(_answered(states).groupBy("block")).applyInArrow(run, ANSWER)


def _word_answers(chunks: DataFrame, parts: int, placed: DataFrame, states: list[State]) -> DataFrame:
    """To each chunk the counts of its words by part, and for each sample their tables as restaurants, customers and tables as dishes.

    The chunk spells its words itself, as their probabilities are eight times as long.
    """
    scales = [s.scale() for s in states]
    schema = "part int, chunk bigint, asked binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in _rows(batches):
            words = unpack_words(row["words"])
            names, first = np.unique(_range_of(_keys(words), parts), return_index=True)
            for name, lo, hi in zip(names.tolist(), first, np.append(first[1:], len(words)), strict=True):
                yield {"part": name, "chunk": row["chunk"], "asked": pack_words(words[lo:hi])}

    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        rows = {row["sweep"]: row for row in table.to_pylist()}
        words, numbers = [], np.zeros((1 + 3 * len(scales), 0), dtype=np.int64)
        if None in rows:
            words = unpack_words(rows[None]["words"])
            numbers = np.array([unpack(rows[None]["n"]), *(unpack(rows[s.sweep][c]) for c in ("t", "customers", "tables") for s in scales)])
        # The last place stands for words that training has not seen.
        numbers = np.append(numbers, np.zeros((len(numbers), 1), dtype=np.int64), axis=1)
        place, out = dict(zip(words, range(len(words)), strict=True)), []
        for row in asked.to_pylist():
            at = np.array([place.get(w, len(words)) for w in unpack_words(row["asked"])], dtype=np.int64)
            out.append({"chunk": row["chunk"], "of_pairs": False, "place": row["part"], "a": pack(numbers[0, at]), "b": pack(numbers[1:, at].ravel())})
        return pa.Table.from_pylist(out, schema=_fields(ANSWER))

    asked = chunks.select("chunk", "words").mapInArrow(lambda batches: _batches(ask(batches), schema), schema)
    return _by_part(placed, states).groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(run, ANSWER)


def score(docs: DataFrame, key: str, text: str, held_out: Column) -> DataFrame:
    """Learns from the rows that aren't ``held_out`` and scores all rows.

    Gives ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.
    """
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Each step ends with a written table, so its shuffles can go with it.
    spark, setting = docs.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        _, chunks = _kept(chunked(docs), "lm-chunks")
        side = sides(-(-_tokens(chunks) // BLOCK_TOKENS))
        words_path, words = _kept(_count_words(chunks, FINER * side), "lm-words")
        pairs_path, pairs = _kept(_count_pairs(chunks, side), "lm-pairs")
        model, placed_path, placed, states = _learn_pairs(words, pairs)
        discard(spark, words_path)
        _, of_pairs = _kept(_pair_answers(pairs, states[:-1], model.pair_discount), "lm-of-pairs")
        # The state before the first sample only seats pairs.
        for path in (pairs_path, states.pop(0).path):
            discard(spark, path)
        _, of_words = _kept(_word_answers(chunks, FINER * side, placed, states), "lm-of-words")
        for path in (placed_path, *(s.path for s in states)):
            discard(spark, path)
    finally:
        spark.conf.set(setting, before)
    shared, scales = spark.sparkContext.broadcast(model), [s.scale() for s in states]

    def add_up(table: pa.Table, answers: pa.Table) -> pa.Table:
        model = shared.value
        samples = len(model.samples)
        row, rows = table.to_pylist()[0], sorted(answers.to_pylist(), key=lambda r: r["place"])
        of_words, of_pairs = ([r for r in rows if r["of_pairs"] is kind] for kind in (False, True))
        words, stream, sizes, pairs = _stream(row)
        counts = np.concatenate([unpack(r["a"]) for r in of_words])
        tables, p, first = np.zeros((samples, len(words)), dtype=np.int64), np.zeros((samples, len(words))), 0
        for r in of_words:
            t, customers, drawn = unpack(r["b"]).reshape(3, samples, -1)
            last = first + t.shape[1]
            word, cells = letters(words[first:last])
            tables[:, first:last] = t
            for i, (state, sample) in enumerate(zip(scales, model.samples, strict=True)):
                p[i, first:last] = state.share(customers[i], drawn[i], _spelled(sample, word, cells, last - first))
            first = last
        p[:, counts == 0] = np.array([[_unknown(model, s)] for s in model.samples])
        base = np.log10((counts + 1) / (model.n + model.v + 1))
        pairs, pair = np.unique(pairs, return_inverse=True)
        u, w, blocks = _dealt(pairs, _keys(words), side)
        n, seated = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
        for (_, at), answer in zip(blocks, of_pairs, strict=True):
            kinds = unpack(answer["a"])
            n[at], seated[at] = kinds, np.where(kinds == 1, samples, 0)
            n[at[kinds == 2]], seated[at[kinds == 2]] = unpack(answer["b"]), unpack(answer["c"])
        score = _log10_seated(model, n, seated, counts[u], (t[u] for t in tables), (x[w] for x in p))
        starts = np.cumsum(sizes) - sizes
        known, base, score = (np.add.reduceat(x[at], starts) for x, at in (((counts > 0).astype(np.int64), stream), (base, stream), (score, pair)))
        pa.default_memory_pool().release_unused()
        return pa.table({
            "doc_id": pa.array(row["docs"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": sizes,
            "n_known": known, "train_tokens": np.full(len(sizes), model.n, dtype=np.int64), "base_score": base, "score": score})

    return chunks.groupBy("chunk").cogroup(of_pairs.unionByName(of_words).groupBy("chunk")).applyInArrow(
        add_up, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _tokens(chunks: DataFrame) -> int:
    """Tokens of all texts, held out ones too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([int(unpack(s.as_py()).sum()) for s in batch.column(0)], pa.int64())})

    return chunks.select("sizes").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of the model and of the base, for the rows held out and the others."""
    def of(column: str) -> Column:
        return F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens"))

    return scored.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))
