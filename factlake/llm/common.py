"""Helpers shared by the operators: stored tables, labelled folds, words of whole texts as numbers.

Words are the runs of bytes other than space and ``\\x09`` to ``\\x0D``, with A-Z
lower-cased. All Python here runs inside tasks on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.session import fresh_path

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# An odd multiplier has an inverse modulo 2**64, which lets one running sum hash every word.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back, which cuts their lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this application's own under the shared folder, once nothing reads it any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


SIEVE_BITS = 1 << 25


def sieved(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose integer ``key`` may be among ``wanted`` (one column), and those whose key surely isn't.

    The first has all that are, and some that aren't. A bitmap of hashed keys, of 4 MB whatever their number, is all that is
    collected and broadcast. It only spares a join rows; with very many wanted
    keys it lets most rows pass, and the result of the join stays the same.
    """
    at = F.pmod(F.xxhash64(wanted.columns[0]), F.lit(SIEVE_BITS))
    found = wanted.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at % 32 AS INT))")).alias("bits")).toArrow()
    bitmap = np.zeros(SIEVE_BITS >> 5, dtype=np.uint32)
    bitmap[np.asarray(found["word"])] = np.asarray(found["bits"])
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    columns = df.columns

    def side(hit: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.asarray(batch.column(len(columns)))
                found = shared.value[at >> 5] >> (at & 31).astype(np.uint32) & 1 == 1
                yield batch.select(range(len(columns))).filter(pa.array(found == hit))

        return df.select("*", F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS)).alias("__sieve_at__")).mapInArrow(run, df.schema)

    return side(True), side(False)


def fold(key: str, folds: int) -> Column:
    """crc32 of an id's text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX[0]
        h = (h ^ (h >> np.uint64(27))) * _MIX[1]
        return h ^ (h >> np.uint64(31))


_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse; kept, as long as the longest asked for."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _INVERSE)):
                _POWERS[i] = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n - 1, base, dtype=np.uint64)]))
    return _POWERS[0][:n], _POWERS[1][:n]


def _hash_slice(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``raw`` and where they start; words end at each of ``cuts`` too."""
    if not len(raw):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    inside = ~_SPACE[raw]
    fresh = np.ones(len(raw), dtype=bool)
    fresh[1:] = ~inside[:-1]
    fresh[cuts[cuts < len(raw)]] = True
    starts = np.flatnonzero(inside & fresh)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    closes = np.ones(len(raw), dtype=bool)
    closes[:-1] = fresh[1:] | ~inside[1:]
    ends = np.flatnonzero(inside & closes)
    up, down = powers(len(raw))
    with np.errstate(over="ignore"):
        sums = np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up)
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        hashes = (sums[ends] - before) * down[starts]
        return mix(hashes + (ends - starts).astype(np.uint64) * _MIX[0]), starts


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields ``(first row, words per row, hashes)`` for runs of rows of about a megabyte.

    A null text has no words. A longer text is a run of its own, hashed piece by
    piece between words, so the working memory follows the longest word, not the text.
    """
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        if last == row + 1 and hi - lo > 2 * SLICE_BYTES:
            yield row, *_long_text(data[lo:hi])
        else:
            cuts = offsets[row:last] - lo
            hashes, starts = _hash_slice(data[lo:hi], cuts)
            owner = np.searchsorted(offsets[row:last + 1] - lo, starts, "right") - 1
            yield row, np.bincount(owner, minlength=last - row)[:last - row], hashes
        row = last


def _long_text(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + SLICE_BYTES)
        while end < len(raw) and not _SPACE[raw[end]]:
            near = np.flatnonzero(_SPACE[raw[end:end + SLICE_BYTES]])
            end = min(len(raw), end + (int(near[0]) if len(near) else SLICE_BYTES))
        parts.append(_hash_slice(raw[at:end], np.zeros(0, dtype=np.int64))[0])
        at = end
    hashes = np.concatenate(parts)
    return np.array([len(hashes)]), hashes


def with_values(docs: DataFrame, keep: list[str], text: str, schema: str, of: Callable[[pa.Array], list[pa.Array]],
                rows: int = 256) -> DataFrame:
    """``keep`` columns with what ``of`` makes of the texts, ``rows`` at a time; ``schema`` names what it makes.

    A kept text travels once. A name that is kept and made is refused.
    """
    columns = keep if text in keep else [*keep, text]
    at, made = columns.index(text), [part.split()[0] for part in schema.split(", ")]
    if clash := set(keep) & set(made):
        raise ValueError(f"kept columns with the name of a result: {sorted(clash)}")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays(part.columns[:len(keep)] + of(part.column(at)), names=[*keep, *made])

    return docs.select(*columns).mapInArrow(run, fields + schema)
