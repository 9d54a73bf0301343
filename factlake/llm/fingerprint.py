"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines, cut after every ``PIECE`` words) become 64-bit
digests, numbered where one repeats. Each digest is added to three cells of a
sketch: a count, the xor of digests and the xor of their checksums. Taking one
sketch from another leaves exactly the digests in which the two texts differ,
and peeling reads them out: a cell with one digest names it, removing that
digest from its other cells uncovers more. If peeling gets stuck, both sketches
are made again four times as large. Many pairs are peeled at once, round by
round; the first size follows an estimate from the smallest digests of both.

A fingerprint is the number of digests and the cells of the smallest sketch, so
equal texts have equal fingerprints. The likeness of two texts is their shared
digests over all their digests.

``neighbours`` brings each document together with the next one in descending
order of its id. Documents are dealt by ranges of ids, and the first document
of each range is also sent to the range before, so no task holds more than a
range. Rows that share an id follow each other in the order of their texts;
null ids come last; the next of the last row is the first.

Defined cases: null is an empty text; two texts without words are alike (1); a
single document is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

PIECE = 24
CELLS = 12
GROWTH = 4
ROWS_PER_RANGE = 2048
ROWS_AT_ONCE = 256
CELLS_AT_ONCE = 1 << 19
SAMPLED = 8
ROUNDS = 1000
_STEP = np.uint64(0x9E3779B97F4A7C15)

Sketch = tuple[np.ndarray, np.ndarray, np.ndarray]


def digests(text: str) -> np.ndarray:
    """Distinct digests of the paragraphs of a text."""
    out, seen = [], {}
    for line in text.split("\n"):
        words = line.split()
        for i in range(0, len(words), PIECE):
            h = xxhash.xxh64_intdigest(" ".join(words[i:i + PIECE]).encode("utf-8", "replace"))
            n = seen[h] = seen.get(h, -1) + 1
            out.append(h if not n else xxhash.xxh64_intdigest(b"%d %d" % (h, n)))
    return np.unique(np.array(out, dtype=np.uint64))


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """Three cells per digest, one in each third of the sketch."""
    third = np.uint64(cells // 3)
    with np.errstate(over="ignore"):
        salted = keys[None, :] + np.arange(1, 4, dtype=np.uint64)[:, None] * _STEP + third
        return (mix(salted) % third).astype(np.int64) + np.arange(3)[:, None] * int(third)


def _checks(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _STEP) >> np.uint64(48)).astype(np.uint16)


def sketch(keys: np.ndarray, cells: int = CELLS) -> Sketch:
    counts = np.zeros(cells, dtype=np.int32)
    xors, checks = np.zeros(cells, dtype=np.uint64), np.zeros(cells, dtype=np.uint16)
    if len(keys):
        places = _places(keys, cells)
        own = _checks(keys)
        for row in places:
            counts += np.bincount(row, minlength=cells).astype(np.int32)
            np.bitwise_xor.at(xors, row, keys)
            np.bitwise_xor.at(checks, row, own)
    return counts, xors, checks


def subtract(a: Sketch, b: Sketch) -> Sketch:
    return a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]


def peel(difference: Sketch) -> tuple[np.ndarray, np.ndarray] | None:
    """The digests only in the first and only in the second sketch, or None if the sketch is too small."""
    counts, xors, checks = (part.copy() for part in difference)
    keys, signs = [], []
    while True:
        pure = np.flatnonzero(np.abs(counts) == 1)
        pure = pure[_checks(xors[pure]) == checks[pure]]
        if not len(pure):
            break
        found, first = np.unique(xors[pure], return_index=True)
        sign = counts[pure[first]]
        # A false match would stand in a cell that isn't its own.
        own = (_places(found, len(counts)) == pure[first]).any(axis=0)
        found, sign = found[own], sign[own]
        if not len(found):
            return None
        for row in _places(found, len(counts)):
            np.subtract.at(counts, row, sign)
            np.bitwise_xor.at(xors, row, found)
            np.bitwise_xor.at(checks, row, _checks(found))
        keys.append(found)
        signs.append(sign)
        if sum(map(len, keys)) > 4 * len(counts):
            return None
    if counts.any() or xors.any():
        return None
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    every, sides = np.concatenate(keys), np.concatenate(signs)
    return every[sides > 0], every[sides < 0]


def _first_cells(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Cells to begin with: by the digests below a bound, an eighth of all, that only one side has."""
    bound = np.uint64((1 << 64) // SAMPLED)
    few = [(a[:np.searchsorted(a, bound)], b[:np.searchsorted(b, bound)]) for a, b in pairs]
    owner = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in few])
    keys = np.concatenate([part for pair in few for part in pair]) if few else np.zeros(0, dtype=np.uint64)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    same = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])
    alone = np.ones(len(keys), dtype=bool)
    alone[1:] &= ~same
    alone[:-1] &= ~same
    about = np.bincount(owner[alone], minlength=len(pairs)) * SAMPLED
    # Sketches smaller than the known difference in number can't be peeled.
    least = np.maximum(1.6 * about, [abs(len(a) - len(b)) for a, b in pairs])
    cells = np.full(len(pairs), CELLS, dtype=np.int64)
    while (small := cells < least).any():
        cells[small] *= GROWTH
    return cells


def _peel_all(pairs: list[tuple[np.ndarray, np.ndarray]], cells: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """``peel`` for many pairs, whose sketches of one size lie one after another."""
    n = len(pairs)
    sizes = np.array([[len(a), len(b)] for a, b in pairs])
    keys = np.concatenate([part for pair in pairs for part in pair])
    owner = np.repeat(np.arange(n), sizes.sum(axis=1))
    sign = np.repeat(np.tile(np.array([1, -1]), n), sizes.ravel())
    counts = np.zeros(n * cells, dtype=np.int64)
    xors, checks = np.zeros(n * cells, dtype=np.uint64), np.zeros(n * cells, dtype=np.uint16)

    def add(keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        at = (_places(keys, cells) + owner * cells).ravel()
        np.add.at(counts, at, np.tile(sign, 3))
        np.bitwise_xor.at(xors, at, np.tile(keys, 3))
        np.bitwise_xor.at(checks, at, np.tile(_checks(keys), 3))
        touched.append(at)

    touched: list[np.ndarray] = []
    add(keys, owner, sign)
    found = []
    for _ in range(ROUNDS):
        # Only cells that changed can have become pure.
        look = np.unique(np.concatenate(touched))
        touched.clear()
        look = look[np.abs(counts[look]) == 1]
        look = look[_checks(xors[look]) == checks[look]]
        keys, owner = xors[look], look // cells
        # A false match would stand in a cell that isn't its own.
        own = (_places(keys, cells) == look % cells).any(axis=0)
        keys, owner, look = keys[own], owner[own], look[own]
        order = np.lexsort((keys, owner))
        keys, owner, look = keys[order], owner[order], look[order]
        if len(keys):
            first = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))
            keys, owner, look = keys[first], owner[first], look[first]
        if not len(keys):
            break
        sign = counts[look]
        add(keys, owner, -sign)
        found.append((owner, keys, sign))
    stuck = (counts.reshape(n, cells) != 0).any(axis=1) | (xors.reshape(n, cells) != 0).any(axis=1)
    owner, keys, sign = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(3))
    order = np.argsort(owner, kind="stable")
    keys, sign = keys[order].astype(np.uint64), sign[order]
    ends = np.cumsum(np.bincount(owner, minlength=n))
    out: list[tuple[np.ndarray, np.ndarray] | None] = []
    for i, end in enumerate(ends.tolist()):
        mine = slice(int(ends[i - 1]) if i else 0, end)
        out.append(None if stuck[i] else (keys[mine][sign[mine] > 0], keys[mine][sign[mine] < 0]))
    return out


def differences(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of sorted digests what only the one and only the other has, from sketches as large as needed."""
    if not pairs:
        return []
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(pairs)
    cells = _first_cells(pairs)
    waiting = np.arange(len(pairs))
    while len(waiting):
        for size in np.unique(cells[waiting]).tolist():
            group = waiting[cells[waiting] == size]
            step = max(1, CELLS_AT_ONCE // size)
            for at in range(0, len(group), step):
                some = group[at:at + step]
                for i, found in zip(some.tolist(), _peel_all([pairs[i] for i in some], size), strict=True):
                    out[i] = found
        waiting = np.array([i for i in waiting if out[i] is None], dtype=np.int64)
        cells[waiting] *= GROWTH
    return out


class Printed:
    """The digests of one text."""

    def __init__(self, text: str):
        self.keys = digests(text)

    def fingerprint(self) -> str:
        counts, xors, checks = sketch(self.keys)
        return f"{len(self.keys):x}:" + counts.astype("<i4").tobytes().hex() + xors.astype("<u8").tobytes().hex() + checks.astype("<u2").tobytes().hex()

    def difference(self, other: Printed) -> tuple[np.ndarray, np.ndarray]:
        """What only this and only the other text has."""
        return differences([(self.keys, other.keys)])[0]

    def likeness(self, other: Printed) -> float:
        return likenesses([(self, other)])[0]


def likenesses(pairs: list[tuple[Printed, Printed]]) -> list[float]:
    """Shared digests over all digests of each pair."""
    out = []
    for (a, b), (mine, its) in zip(pairs, differences([(a.keys, b.keys) for a, b in pairs]), strict=True):
        both, apart = len(a.keys) + len(b.keys), len(mine) + len(its)
        out.append((both - apart) / (both + apart) if both else 1.0)
    return out


def neighbours(docs: DataFrame, key: str, text: str, made: Callable[[list[tuple[int | None, str, str]]], pa.Table], schema: str,
               rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``made`` of runs of (id, text, next text), at most about ``rows_per_range`` in a task at once."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("body"))
    ids = docs.select("id")
    ranges = -(-ids.count() // rows_per_range)
    cuts: list[float] = []
    if ranges > 1:
        # As Spark's own range partitioning: one bound per range comes to the driver.
        cuts = sorted(set(ids.approxQuantile("id", [i / ranges for i in range(1, ranges)], max(1e-4, 1 / (8 * ranges)))))
    bounds = np.array(cuts, dtype=np.int64)

    def range_of(values: pa.Array) -> np.ndarray:
        known = values.is_valid().to_numpy(zero_copy_only=False)
        return np.where(known, np.searchsorted(bounds, values.fill_null(0).to_numpy(zero_copy_only=False), "right"), 0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range_of(batch.column(0)).astype(np.int32)), batch.column(0)], names=["part", "id"])

    heads = ids.mapInArrow(place, "part int, id bigint").groupBy("part").agg(F.max("id").alias("id")).orderBy("part").collect()
    # The first id of a range, and the range that ends before it; the first of all follows the last.
    sent = {r.id: heads[(i + 1) % len(heads)].part for i, r in enumerate(heads)} if len(heads) > 1 else {}
    guest_ids = pa.array([i for i in sent if i is not None], pa.int64())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bodies = batch.column(0), batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range_of(at).astype(np.int32)), pa.array(np.zeros(len(at), dtype=bool)), at, bodies],
                names=["part", "guest", "id", "body"])
            mask = pa.compute.is_in(at, guest_ids)
            if None in sent:
                mask = pa.compute.or_(mask, at.is_null())
            also = batch.filter(mask)
            if also.num_rows:
                goal = pa.array([sent[i] for i in also.column(0).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([goal, pa.array([True] * len(goal)), *also.columns], names=["part", "guest", "id", "body"])

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(table["guest"].to_pylist(), table["id"].to_pylist(), table["body"].to_pylist(), strict=True))
        order = lambda r: (r[1] is None, -(r[1] or 0), r[2] is not None, r[2] or "")
        own = sorted((r for r in rows if not r[0]), key=order)
        if not own:
            return made([])
        first = min((r for r in rows if r[0]), key=order, default=own[0])
        following = [r[2] or "" for r in own[1:]] + [first[2] or ""]
        return made([(r[1], r[2] or "", n) for r, n in zip(own, following, strict=True)])

    dealt = docs.mapInArrow(deal, "part int, guest boolean, id bigint, body string")
    if ranges <= 1:
        return dealt.groupBy("part").applyInArrow(run, schema)
    spread = max(1, min(ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.repartition(spread, "part").groupBy("part").applyInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the beginning of another."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def compare_edits(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are to it and the next one."""

    def made(rows: list[tuple[int | None, str, str]]) -> pa.Table:
        out, ready = [], None
        for at in range(0, len(rows), ROWS_AT_ONCE):
            part, prints = rows[at:at + ROWS_AT_ONCE], []
            for _, own, following in part:
                mine = ready or Printed(own)
                ready = Printed(following)
                changed = edited(own, following)
                prints.append((mine, Printed(changed), ready, hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()))
            near = likenesses([pair for mine, other, following, _ in prints for pair in ((mine, other), (mine, following))])
            out += [(i, len(own), digest, mine.fingerprint(), other.fingerprint(), near[2 * j], near[2 * j + 1])
                    for j, ((i, own, _), (mine, other, _, digest)) in enumerate(zip(part, prints, strict=True))]
        columns = list(zip(*out, strict=True)) or [()] * 7
        return pa.table([pa.array(c, t) for c, t in zip(
            columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return neighbours(docs, key, text, made, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
                                             "edited_fingerprint string, near_edited double, near_next double")
