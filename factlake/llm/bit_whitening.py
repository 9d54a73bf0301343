"""Embedding whitening from exact, bit-sliced covariances.

A component ``c`` becomes the whole number ``floor(1024 * c) + 100000``. Each
block of rows is shifted by its own least value per dimension, and the bits of
what is left are packed across rows into 64-bit words: one plane per dimension
and bit. A cross-product of two dimensions is then the sum over their planes of
``2 ** (bit + bit)`` times the ones in the AND of both planes, so it is exact.
Tasks give whole sums, as limbs of 40 bits that Spark adds up; the driver
receives one number per pair of dimensions, however many rows there are. It
takes the means off in whole numbers, too, and only then turns to floating
point for the eigenvectors.

Every row is fitted on and whitened; a third pass measures the covariance of
the whitened rows themselves for ``identity_error``.

Defined cases: rows whose vector is null, has null or non-finite components, or
has another length than most (the longer of equally common ones) take no part
and give no rows; a vector of zeros takes part. Components beyond ``2 ** 53``
after scaling count as that. Repeated rows count each time, rows with a null id
too. With fewer than ``k`` dimensions there are as many components. A component
without variance has ``whitened`` and ``explained`` 0 and does not enter the
error. An empty table gives an empty one. ``deviation`` is a decimal of 38
digits, null beyond them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
SHIFT = 100_000
LARGEST = float(1 << 53)
COMPONENTS = 8
BLOCK_ROWS = 1 << 14
LIMB = 40
LIMBS = 4
RESULTS = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def finite(vector: Column) -> Column:
    """Not null, and neither is any component, which are all finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine, F.lit(False))


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(vectors * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def planes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of unsigned numbers (rows by dimensions): words per plane, and each plane's dimension and bit."""
    rows, dim = values.shape
    bits = [int(top).bit_length() for top in values.max(axis=0, initial=0)]
    of_dim = np.repeat(np.arange(dim), bits)
    of_bit = np.concatenate([np.arange(b) for b in bits]) if dim else np.zeros(0, dtype=np.int64)
    out = np.zeros((len(of_dim), -(-rows // 64) * 8), dtype=np.uint8)
    columns = np.ascontiguousarray(values.T)
    for b in range(max(bits, default=0)):
        at = np.flatnonzero(of_bit == b)
        packed = np.packbits((columns[of_dim[at]] >> np.uint64(b) & np.uint64(1)).astype(bool), axis=1)
        out[at, :packed.shape[1]] = packed
    return out.view(np.uint64), of_dim, of_bit


def cross_products(values: np.ndarray) -> np.ndarray:
    """Exact sums over rows of the products of each two columns of unsigned numbers."""
    words, of_dim, of_bit = planes(values)
    dim, n = values.shape[1], len(words)
    both = np.zeros((n, n), dtype=np.int64)
    for p in range(n):
        both[p, p:] = np.bitwise_count(words[p:] & words[p]).sum(axis=1, dtype=np.uint32)
    both += np.triu(both, 1).T
    small = int(values.max(initial=0)) ** 2 * len(values) < 1 << 63
    weight = 1 << of_bit if small else np.array([1 << int(b) for b in of_bit], dtype=object)
    both = both * weight[:, None] * weight
    out = np.zeros((dim, dim), dtype=object)
    some, starts = np.unique(of_dim, return_index=True)
    if len(some):
        sums = np.add.reduceat(np.add.reduceat(both, starts, axis=0), starts, axis=1)
        out[np.ix_(some, some)] = sums.astype(object)
    return out


class Sums:
    """Exact number of rows, sums and cross-products of whole numbers, as Python integers."""

    def __init__(self, dim: int):
        self.n, self.sums, self.cross = 0, np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)

    def add(self, x: np.ndarray) -> None:
        low = x.min(axis=0)
        shifted = (x.view(np.uint64) - low.view(np.uint64))
        n, low = len(x), low.astype(object)
        halves = (shifted & np.uint64(0xFFFFFFFF)).sum(axis=0), (shifted >> np.uint64(32)).sum(axis=0)
        plus = halves[0].astype(object) + (halves[1].astype(object) << 32)
        mixed = plus[:, None] * low
        self.n += n
        self.sums = self.sums + plus + n * low
        self.cross = self.cross + cross_products(shifted) + mixed + mixed.T + n * low[:, None] * low


def _limbs(value: int) -> list[int]:
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & (1 << LIMB) - 1)
        value >>= LIMB
    return [*out, value]


@dataclass
class Model:
    dim: int
    n: int
    sums: list[int]
    covariance: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact."""
        largest = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0))
        if largest < 1 << 62:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def project(self, x: np.ndarray) -> np.ndarray:
        spread = np.sqrt(self.values)
        axes = np.where(spread > 0, self.vectors / np.where(spread > 0, spread, 1), 0)
        return (self.centred(x) / self.n).astype(np.float64) @ axes

    def deviations(self, x: np.ndarray) -> pa.Array:
        d = self.centred(x)
        if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * self.dim < 1 << 63:
            return pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
        d = d.astype(object)
        return pa.array([Decimal(v) if v < 10 ** 38 else None for v in (d * d).sum(axis=1)], pa.decimal128(38, 0))


def _plain(df: DataFrame, keep: list[str], vector: str, dim: int | None = None) -> DataFrame:
    """Kept columns by place, the vector last; only rows that take part."""
    df = df.select(*[F.col(f"`{name}`").alias(f"k{i}") for i, name in enumerate(keep)], F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return df.filter(finite(F.col("v")) if dim is None else finite(F.col("v")) & (F.size("v") == dim))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return whole_numbers(np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim))


def fit(df: DataFrame, vector: str, k: int = COMPONENTS) -> Model | None:
    """Exact sums of all rows that take part, and the ``k`` strongest components; without rows None."""
    lengths = _plain(df, [], vector).groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = lengths[0].dim if lengths else 0
    if not dim:
        return None

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, rows = Sums(dim), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(_matrix(batch.column(0).slice(at, BLOCK_ROWS), dim))
                rows += len(held[-1])
                if rows >= BLOCK_ROWS:
                    total.add(np.concatenate(held))
                    held, rows = [], 0
        if rows:
            total.add(np.concatenate(held))
        if total.n:
            i, j = np.triu_indices(dim)
            names = [(-1, -1), *[(d, -1) for d in range(dim)], *zip(i.tolist(), j.tolist(), strict=True)]
            limbs = np.array([_limbs(int(v)) for v in (total.n, *total.sums, *total.cross[i, j])], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"i": pa.array([a for a, _ in names], pa.int32()), "j": pa.array([b for _, b in names], pa.int32())}
                                             | {f"l{m}": pa.array(limbs[:, m]) for m in range(LIMBS)})

    fields = ", ".join(f"l{m} bigint" for m in range(LIMBS))
    rows = (_plain(df, [], vector, dim).mapInArrow(summed, f"i int, j int, {fields}")
            .groupBy("i", "j").agg(*[F.sum(f"l{m}").alias(f"l{m}") for m in range(LIMBS)]).collect())
    found = {(r.i, r.j): sum(r[f"l{m}"] << LIMB * m for m in range(LIMBS)) for r in rows}
    n, sums = found[-1, -1], [found[d, -1] for d in range(dim)]
    covariance = np.empty((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            # Whole numbers divide to the nearest double.
            covariance[i, j] = covariance[j, i] = (n * found[i, j] - sums[i] * sums[j]) / (n * n)
    return components(dim, n, sums, covariance, k)


def components(dim: int, n: int, sums: list[int], covariance: np.ndarray, k: int) -> Model:
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    values = np.where(values > dim * np.finfo(float).eps * max(values[0], 0.0), values, 0.0)
    trace = float(np.trace(covariance))
    explained = values / trace if trace else np.zeros(dim)
    return Model(dim, n, sums, covariance, vectors[:, :k].copy(), values[:k], explained[:k])


def identity_error(df: DataFrame, vector: str, model: Model) -> float:
    """The largest entry of the whitened rows' covariance less the identity, over components with variance."""
    live = np.flatnonzero(model.values > 0)
    m = len(live)
    if not m:
        return 0.0
    shared = df.sparkSession.sparkContext.broadcast(model)
    i, j = np.triu_indices(m + 1)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m + 1))
        for batch in batches:
            w = shared.value.project(_matrix(batch.column(0), shared.value.dim))[:, live]
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
            total += w.T @ w
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "part": pa.array(total[i, j])})

    rows = (_plain(df, [], vector, model.dim).mapInArrow(summed, "i int, j int, part double")
            .groupBy("i", "j").agg(F.sum("part").alias("part")).collect())
    total = np.zeros((m + 1, m + 1))
    for r in rows:
        total[r.i, r.j] = total[r.j, r.i] = r.part
    mean = total[:m, m] / model.n
    return float(np.abs(total[:m, :m] / model.n - np.outer(mean, mean) - np.eye(m)).max())


def whiten(df: DataFrame, keep: list[str], vector: str, k: int = COMPONENTS) -> DataFrame:
    """``keep`` columns and ``RESULTS``: a row per vector and component, strongest first."""
    spark, made = df.sparkSession, [part.split()[0] for part in RESULTS.split(", ")]
    if clash := set(keep) & set(made):
        raise ValueError(f"kept columns with the name of a result: {sorted(clash)}")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*[F.col(f"`{name}`") for name in keep]).schema)
    model = fit(df, vector, k)
    if model is None:
        return spark.createDataFrame([], fields + RESULTS)
    error, shared = identity_error(df, vector, model), spark.sparkContext.broadcast(model)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = shared.value, len(shared.value.values)
        for batch in batches:
            x = _matrix(batch.column(len(keep)), own.dim)
            each, n = pa.array(np.repeat(np.arange(len(x)), size)), len(x) * size
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(each) for i in range(len(keep))]
                + [pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))), pa.array(np.full(n, own.n, dtype=np.int64)),
                   own.deviations(x).take(each), pa.array(own.project(x).ravel()), pa.array(np.tile(own.explained, len(x))),
                   pa.array(np.full(n, error))], names=[*keep, *made])

    return _plain(df, keep, vector, model.dim).mapInArrow(whitened, fields + RESULTS)
