"""Toxicity from two Kneser-Ney models, one of toxic and one of ordinary texts.

Each model counts a word by its continuations: how many different words it
follows in the texts of its class, so that copies and repeated passages count
once. Counts are discounted, and what is taken off goes to the continuation
counts of both classes together. This level is shared, so an expression that is
rare in both classes backs off to the same share and says nothing; a class
speaks for itself only with counts above the discount, which is chosen on
labelled rows that the counts have not seen. (A level of word pairs above this
one was tried and left out: pairs of common words told the classes apart by chance.)

A text is judged by the difference of its two log-likelihoods per word, of
which each word gives what it has above ``CALM``: the many common words differ a
little with the languages in each class, and ordinary words must not make up
for toxic ones. The same unseen rows turn the log of the difference into a probability.

The models are fitted on a bounded sample: at most ``PER_CLASS`` documents of
each class, whole texts; the tables hold only what is counted above the discount.

Defined cases: a null or empty text, or one without words, has a difference of
0; several labels for one document count as toxic if one is; null labels teach
nothing; without labels of both classes every score is the share of toxic
labels (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_values, word_hashes
from .sampling import labelled_sample

PER_CLASS = 2000
CALIBRATION = 4
DISCOUNTS = (0.75, 2.0, 4.0, 8.0, 12.0)
CALM = 1.0
BEGIN = np.uint64(0x5851F42D4C957F2D)
# A difference of half a thousandth per word is as good as none.
NONE = 5e-4


def _previous(words: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """The word before each word, ``BEGIN`` at the start of a row."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    starts = np.cumsum(per_row) - per_row
    out[starts[per_row > 0]] = BEGIN
    return out


@dataclass
class Table:
    """A toxic and an ordinary value by sorted key."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    values: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys)
        return cls(keys[order], np.asarray(values)[:, order])

    def get(self, keys: np.ndarray, default: tuple[float, float]) -> np.ndarray:
        out = np.empty((2, len(keys)))
        out[0], out[1] = default
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[place] == keys)
            out[:, hit] = self.values[:, place[hit]]
        return out


@dataclass
class Model:
    """``words`` names what a class counts above the discount.

    Any other word has its shared probability times ``spare`` in each class, so
    its difference does not depend on the probability, and 1 stands for it.
    """

    words: Table
    spare: tuple[float, float]
    slope: float = 1.0
    bias: float = 0.0
    constant: float | None = None

    def word_differences(self, words: np.ndarray) -> np.ndarray:
        p = self.words.get(words, self.spare)
        return np.maximum(np.log(p[0] / p[1]) - CALM, 0)

    def differences(self, texts: pa.Array) -> np.ndarray:
        """Toxic minus ordinary log-likelihood above ``CALM``, per word of each text."""
        out = np.zeros(len(texts))
        for first, per_row, words in word_hashes(texts):
            out[first:first + len(per_row)] = _means(self.word_differences(words), per_row)
        return out

    def probability(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(differences + NONE) + self.bias, -40, 40)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return self.probability(self.differences(texts))


def _means(values: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(per_row)
    return (sums[ends] - sums[ends - per_row]) / np.maximum(per_row, 1)


def constant(share: float) -> Model:
    return Model(Table(), (1.0, 1.0), constant=share)


def fit(names: np.ndarray, own: np.ndarray, both: np.ndarray, d: float) -> Model:
    """From each word's toxic and ordinary continuation counts (two rows) and that of both, discounted by ``d``."""
    e = _discount(both)
    shared = (np.maximum(both - e, 0) + e * (both > 0).sum() / (len(names) + 1)) / max(1.0, both.sum())
    totals = np.maximum(own.sum(axis=1), 1)
    spare = np.minimum(own, d).sum(axis=1) / totals
    p = np.maximum(own - d, 0) / totals[:, None] + spare[:, None] * shared
    named = own.max(axis=0) > d
    return Model(Table.of(names[named], p[:, named]), (float(spare[0]), float(spare[1])))


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and bias with a class weight that gives the toxic share of all labels, not of the sample."""
    weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    scale = x.std() or 1.0
    z, slope, bias = x / scale, 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * z + bias, -40, 40)))
        g = np.array([(weight * (p - y) * z).sum() + 1e-2 * slope, (weight * (p - y)).sum()])
        r = weight * p * (1 - p)
        h = np.array([[(r * z * z).sum() + 1e-2, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())
        slope, bias = slope - step[0], bias - step[1]
    return float(max(slope, 0.0) / scale), float(bias)


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int = PER_CLASS,
          may_learn: Column | None = None) -> Model:
    """Fits both models; ``labels`` has ``key`` and ``label`` (0 or 1), ``may_learn`` is a condition on the key."""
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    if may_learn is not None:
        marks = marks.filter(may_learn)
    marks = marks.groupBy(key).agg(F.max(label).alias("mark"))
    # Only documents at hand are learned from.
    marks = marks.join(docs.select(key).distinct(), key, "left_semi")
    n = {r.mark: r.n for r in marks.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return constant(share)
    picked = labelled_sample(marks, key, "mark", per_class, 2).collect()
    chosen = docs.sparkSession.createDataFrame(picked, docs.select(F.col(key).alias("picked"), F.lit(0).alias("mark")).schema)
    # At most 2 * per_class ids.
    rows = docs.select(key, text).join(F.broadcast(chosen), docs[key] == F.col("picked"))
    later = F.pmod(F.xxhash64(F.lit("calibration"), F.col("picked").cast("string")), F.lit(CALIBRATION)) == 0
    rows = rows.select("mark", later.alias("later"), text)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.asarray(batch.column(0))
            for first, per_row, words in word_hashes(batch.column(1)):
                yield pa.RecordBatch.from_pydict({
                    "mark": np.repeat(marks[first:first + len(per_row)], per_row),
                    "before": _previous(words, per_row).view(np.int64), "word": words.view(np.int64)})

    counted = (
        rows.filter("NOT later").select("mark", text).mapInArrow(pairs, "mark int, before bigint, word bigint")
        .groupBy("before", "word").agg(F.max("mark").alias("toxic"), F.max(1 - F.col("mark")).alias("ordinary"))
        .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.count("*").alias("both"))
    ).toArrow()
    names, both = np.asarray(counted["word"]).view(np.uint64), np.asarray(counted["both"]).astype(float)
    own = np.array([np.asarray(counted["toxic"]), np.asarray(counted["ordinary"])], dtype=float)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, per_row, words in word_hashes(batch.column(1)):
                cuts = np.concatenate([[0], np.cumsum(per_row)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(per_row)), pa.ListArray.from_arrays(cuts.astype(np.int32), words.view(np.int64))],
                    names=["mark", "words"])

    held = rows.filter("later").select("mark", text).mapInArrow(hashed, "mark int, words array<bigint>").toArrow()
    truth = np.asarray(held["mark"]).astype(float)
    listed = held["words"].combine_chunks() if len(held) else pa.array([], pa.list_(pa.int64()))
    per_row = np.asarray(listed.value_lengths()).astype(np.int64)
    words = np.asarray(listed.flatten()).view(np.uint64)
    if not 0 < truth.sum() < len(truth):
        model = fit(names, own, both, DISCOUNTS[0])
        model.bias = float(np.log(share / (1 - share)))
        return model
    best = None
    for d in DISCOUNTS:
        model = fit(names, own, both, d)
        x = _means(model.word_differences(words), per_row)
        model.slope, model.bias = _logistic(np.log(x + NONE), truth, share)
        p = np.clip(model.probability(x), 1e-6, 1 - 1e-6)
        loss = -(np.log(p[truth > 0]).mean() * share + np.log(1 - p[truth == 0]).mean() * (1 - share))
        if best is None or loss < best[0]:
            best = loss, model
    return best[1]


def score(docs: DataFrame, keep: list[str], text: str, model: Model) -> DataFrame:
    """``keep`` columns with ``score`` and ``predicted``, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(column: pa.Array) -> list[pa.Array]:
        scores = shared.value.scores(column)
        return [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]

    return with_values(docs, keep, text, "score double, predicted int", of)
