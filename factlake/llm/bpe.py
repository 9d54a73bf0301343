"""Byte-level BPE with a rank queue, and decoding.

``RankQueue`` has one bucket per merge rank, holding positions of a linked list,
and a bitmap of three levels over the buckets: find-first-set on each level
gives the lowest rank in three steps however long the pre-token is. A merge
leaves the entries of its two neighbour pairs behind; they are recognised as
stale when they come up and skipped. So a pre-token of ``n`` bytes costs
``O(n log n)`` instead of the ``O(n * n)`` of a scan for the lowest rank.

Defined cases: a null or empty text has no ids; bytes outside the vocabulary
raise; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import with_values

# Distinct pre-tokens that a worker keeps, about 100 MB.
CACHE_ENTRIES = 400_000
CACHED_PIECE = 64
# Longer texts are split piece by piece, and decoded in parts.
LONG_TEXT = 1_000_000
DECODED_AT_ONCE = 1 << 18


class RankQueue:
    """Lowest rank first, and its lowest position first."""

    def __init__(self, size: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * (size // 64 + 1)
        self.mid = [0] * (size // 4096 + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        a = (top & -top).bit_length() - 1
        mid = self.mid[a]
        b = a << 6 | (mid & -mid).bit_length() - 1
        low = self.low[b]
        rank = b << 6 | (low & -low).bit_length() - 1
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[b] = low = low & (low - 1)
            if not low:
                self.mid[a] = mid = mid & (mid - 1)
                if not mid:
                    self.top = top & (top - 1)
        return rank, position


class Codec:
    """Encodes and decodes with one vocabulary; lives in a Python worker and keeps pieces it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        # All tokens end to end, with the place and size of each id.
        self.sizes = np.full(max(ranks.values(), default=0) + 1, -1, dtype=np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        known = np.maximum(self.sizes, 0)
        self.starts = np.cumsum(known) - known
        self.flat = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), dtype=np.uint8)
        self.longest = max(map(len, ranks), default=1)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: adjacent parts join in order of rank, leftmost first."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        get, queue, longest = self.ranks.get, self.queue, self.longest
        n = len(piece)
        # after[i]: where the part that starts at i ends; before[i]: where the part left of it starts.
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        # The rank a live entry at i must have; anything else in the queue is stale.
        wanted = [-1] * n
        for i in range(n - 1):
            rank = get(piece[i:i + 2])
            if rank is not None:
                wanted[i] = rank
                queue.push(rank, i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            if wanted[i] != rank:
                continue
            middle = after[i]
            end = after[i] = after[middle]
            wanted[i] = wanted[middle] = -1
            if end < n:
                before[end] = i
                if (stop := after[end]) - i <= longest and (rank := get(piece[i:stop])) is not None:
                    wanted[i] = rank
                    queue.push(rank, i)
            left = before[i]
            if left >= 0:
                rank = get(piece[left:end]) if end - left <= longest else None
                if rank is None:
                    wanted[left] = -1
                elif wanted[left] != rank:
                    wanted[left] = rank
                    queue.push(rank, left)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i:after[i]]])
            i = after[i]
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as 32-bit numbers."""
        if not text:
            return np.zeros(0, dtype="<u4")
        cache, out = self.cache, []
        pieces = self.pattern.findall(text) if len(text) < LONG_TEXT else (m.group() for m in self.pattern.finditer(text))
        for piece in pieces:
            packed = cache.get(piece)
            if packed is None:
                packed = array("I", self.merge(piece.encode())).tobytes()
                if len(piece) <= CACHED_PIECE and len(cache) < CACHE_ENTRIES:
                    cache[piece] = packed
            out.append(packed)
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: Sequence[int] | np.ndarray) -> bytes:
        """The bytes of the ids; an id that the vocabulary lacks is an error."""
        ids = np.asarray(ids, dtype=np.int64)
        sizes = self.sizes[ids]
        if len(ids) and (ids.min() < 0 or sizes.min() < 0):
            raise KeyError("an id outside the vocabulary")
        out = []
        for at in range(0, len(ids), DECODED_AT_ONCE):
            starts, n = self.starts[ids[at:at + DECODED_AT_ONCE]], sizes[at:at + DECODED_AT_ONCE]
            out.append(self.flat[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
        return b"".join(out)


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """A rank file: base64 of the token, a space and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a worker, read once from a rank file that every machine has."""
    if (path, pattern) not in _CODECS:
        with open(path, "rb") as lines:
            _CODECS[path, pattern] = Codec(read_ranks(lines), pattern)
    return _CODECS[path, pattern]


def encode(df: DataFrame, keep: list[str], text: str, path: str, pattern: str) -> DataFrame:
    """``keep`` columns with ``ids``, the ids of the whole text."""

    def of(texts: pa.Array) -> list[pa.Array]:
        own = codec(path, pattern)
        return [pa.array([own.encode(t.as_py()).astype("int32") for t in texts], pa.list_(pa.int32()))]

    return with_values(df, keep, text, "ids array<int>", of)


def round_trip(df: DataFrame, keep: list[str], text: str, path: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass: ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    The digests are lowercase hex of the ids as little-endian unsigned 32-bit
    numbers, and of the bytes that the ids decode to.
    """

    def of(texts: pa.Array) -> list[pa.Array]:
        own, made = codec(path, pattern), []
        for value in texts:
            ids = own.encode(value.as_py())
            made.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
        return [pa.array([m[i] for m in made]) for i in range(3)]

    return with_values(df, keep, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", of)
