"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a string of 64 bits: the side of a hyperplane it
lies on, for 64 random hyperplanes. A tree is the sorted array of its strings.
A query descends in each tree to the longest prefix that any vector shares with
it, then all trees ascend together, a bit at a time, until the ranges of
vectors that share the current prefix hold enough different candidates. These
are ranked by exact distance.

Vectors are dealt into shards by a hash of their id, each with a forest of its
own; every query visits every shard, in blocks, and the best of the shards are
merged. ``share`` says how much of a shard a query must have seen before the
ascent stops. It is a share, not a number, so recall holds as the table grows.

The hyperplanes are centred on a bounded sample (``SAMPLE`` vectors), which is
all that is fitted; every vector is indexed.

Defined cases: vectors that are null, zero, of another length than most of the
sample, or hold null or non-finite components take no part, as query or as
candidate; so do rows with a null id. A repeated id is several candidates,
none of them for a query of that id. With fewer than ``k`` candidates all are
returned. Equal distances go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES = 48
BITS = 64
SHARE = 0.5
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
SAMPLE = 2000
SEED = 11


def usable(vector: Column, dim: int | None = None) -> Column:
    """Has only finite components and some length."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    fits = F.size(vector) == dim if dim is not None else F.size(vector) > 0
    return F.coalesce(vector.isNotNull() & fits & finite & some, F.lit(False))


class Planes:
    """Random hyperplanes through about the middle of the data."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.normals = rng.normal(size=(dim, trees * BITS)).astype(np.float32)
        self.middle = sample.mean(axis=0).astype(np.float32)
        self.trees = trees

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """One 64-bit string per tree (rows) and vector (columns); the first plane is the highest bit."""
        out = np.empty((self.trees, len(vectors)), dtype=np.uint64)
        centred = vectors.astype(np.float32) - self.middle
        for t in range(self.trees):
            sides = centred @ self.normals[:, t * BITS:(t + 1) * BITS] > 0
            out[t] = np.packbits(sides, axis=1).view(">u8").ravel().astype(np.uint64)
        return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of 64-bit strings."""
    x = a ^ b
    out = np.full(x.shape, BITS, dtype=np.int64)
    some = x != 0
    high = np.zeros(x.shape, dtype=np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        big = x >> np.uint64(width) != 0
        high += width * big
        x = np.where(big, x >> np.uint64(width), x)
    out[some] = BITS - 1 - high[some]
    return out


class Forest:
    """Sorted arrays of one shard."""

    def __init__(self, planes: Planes, vectors: np.ndarray):
        strings = planes.strings(vectors)
        self.planes, self.n = planes, len(vectors)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def candidates(self, query: np.ndarray, share: float, least: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """For each query the rows of the shard to rank: its share, and at least ``least`` rows if there are as many."""
        floors = np.zeros(len(query), dtype=np.int64) if least is None else least
        for strings, floor in zip(self.planes.strings(query).T, floors, strict=True):
            wanted = min(self.n, max(int(np.ceil(share * self.n)), int(floor)))
            # Descend: the longest match stands next to where the query would be.
            deepest = 0
            for t, s in enumerate(strings):
                at = int(np.searchsorted(self.sorted[t], s))
                near = self.sorted[t][max(0, at - 1):at + 1]
                deepest = max(deepest, int(_common(near, s).max(initial=0)))
            # Ascend in all trees together.
            seen = np.zeros(self.n, dtype=bool)
            spans = [(0, 0)] * len(strings)
            for depth in range(deepest, -1, -1):
                mask = ~np.uint64(0) << np.uint64(BITS - depth) if depth else np.uint64(0)
                for t, s in enumerate(strings):
                    low = s & mask
                    a = int(np.searchsorted(self.sorted[t], low, "left"))
                    b = int(np.searchsorted(self.sorted[t], low | ~mask, "right"))
                    c, d = spans[t] if spans[t][1] else (a, a)
                    if a < c or d < b:
                        seen[self.order[t, a:c]] = True
                        seen[self.order[t, d:b]] = True
                        spans[t] = a, b
                if np.count_nonzero(seen) >= wanted:
                    break
            yield np.flatnonzero(seen)


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 10, share: float = SHARE,
            trees: int = TREES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (Euclidean distance) of each query's ``k`` nearest found."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    def plain(df: DataFrame, dim: int | None = None) -> DataFrame:
        return df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(
            F.col("id").isNotNull() & usable(F.col("v"), dim))

    sample = plain(rows).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not sample:
        return empty
    dim = pd.Series([len(r.v) for r in sample]).mode().iloc[0].item()
    planes = spark.sparkContext.broadcast(Planes(np.array([r.v for r in sample if len(r.v) == dim]), trees))
    points, asked = plain(rows, dim), plain(queries, dim)
    shards = max(1, -(-points.count() // shard_rows))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    # A grid of blocks: vectors go once to each block of queries, queries once to each shard.
    points = points.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"),
                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                         F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v")

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten()).reshape(-1, dim)

    def search(ask: pa.Table, index: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if len(ask) and len(index):
            ids, vectors = np.asarray(index["id"]), matrix(index["v"])
            forest = Forest(planes.value, vectors)
            asking, query = np.asarray(ask["id"]), matrix(ask["v"])
            # A query's own rows are not among its neighbours.
            names = np.sort(ids)
            own = np.searchsorted(names, asking, "right") - np.searchsorted(names, asking, "left")
            for name, q, found in zip(asking, query, forest.candidates(query, share, k + own), strict=True):
                found = found[ids[found] != name]
                far = np.sqrt(((vectors[found] - q) ** 2).sum(axis=1))
                best = np.lexsort((ids[found], far))[:k]
                for part, value in zip(out, (np.full(len(best), name), ids[found][best], far[best]), strict=True):
                    part.append(value)
        cells = [np.concatenate(p) if p else np.zeros(0) for p in out]
        return pa.table({"query_id": pa.array(cells[0].astype(np.int64)), "vec_id": pa.array(cells[1].astype(np.int64)),
                         "score": pa.array(cells[2].astype(np.float64))})

    found = asked.groupBy("shard", "block").cogroup(points.groupBy("shard", "block")).applyInArrow(
        search, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
