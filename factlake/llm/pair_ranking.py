"""Quality by Bradley-Terry ranking of document pairs.

A document has a strength: a weighted sum of features of its whole text (kinds
of characters, words, lines, repetition, each also squared). In a pair, the
document of higher quality wins with the logistic function of the difference of
strengths, so the weights are fitted by logistic loss on feature differences;
nothing is learned but which of two is better. Pairs join documents of the two
labels, each document in several pairs, drawn in a seeded order.

What is kept is decided by a quantile of the strengths. Labelled rows that no
pair has seen say which: of all quantiles, the one with the best mean of both
labels' shares of right answers. ``score`` is the logistic function of the
strength less that cut, moved so that the cut has ``CUT``.

Fitted on every labelled document. Their features are dealt by a hash of the id
into cells of about ``CELL``, and pairs are drawn within a cell; documents of the
rarer label are put into several cells where there would be too few of them. A step of
Newton's method adds up the cells where they lie, and the driver receives one
sum per task. The quantile is found by running counts over ranges of strengths.

Defined cases: a null or empty text, or one without words, has features 0 apart
from its length, and a score like others. Of rows that share an id the least features
teach. Several labels for one document count
as high if one is; null labels teach nothing; without labels of both kinds every
score is the share of high labels (0 without any). Rows that repeat an id stay
rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grouping import range_sum_before
from .common import mix, stored, with_values, word_hashes

CELL = 1000
RARE_IN_CELL = 50
HELD_BACK = 4
PAIRS_EACH = 12
RIDGE = 1.0
CUT = 0.3
LONGEST_REACH = 6.0
SEED = 17
SHINGLE = 3
SLICE_BYTES = 1 << 20

# Kinds of bytes: lower-case, capitals, digits, spaces, line ends, full stops, commas, other marks of prose, other signs, beyond ASCII.
KINDS = 10
_KIND = np.full(256, 8, dtype=np.uint8)
for _kind, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".", b",", b";:!?'\"()-")):
    _KIND[list(_bytes)] = _kind
_KIND[128:] = 9
_LETTER_KIND = np.isin(np.arange(KINDS), (0, 1, 9))
NAMES = ("lower", "upper", "digits", "spaces", "lines", "stops", "commas", "marks", "signs", "beyond",
         "length", "word length", "short words", "signs after letters", "capitals after capitals", "words a stop",
         "words a line", "different words", "different runs", "repeated next")


def _shares(counts: np.ndarray, of: np.ndarray) -> np.ndarray:
    return counts / np.maximum(of, 1)


def _different(values: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """How many different values each row has."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    fresh = np.ones(len(v), dtype=bool)
    fresh[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[fresh], minlength=rows)


def features(texts: pa.Array) -> np.ndarray:
    """A row per text, a column per name."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    rows = len(texts)
    kinds, signs, capitals = np.zeros((rows, KINDS)), np.zeros(rows), np.zeros(rows)
    at = 0
    while at < rows:
        # Runs of rows of about a slice; a longer text alone, slice by slice.
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        for low in range(int(offsets[at]), int(offsets[stop]), SLICE_BYTES * 2):
            high = min(low + SLICE_BYTES * 2, int(offsets[stop]))
            kind = _KIND[raw[low:high]]
            owner = np.searchsorted(offsets[at:stop + 1], np.arange(low, high), "right") - 1
            kinds[at:stop] += np.bincount(owner * KINDS + kind, minlength=(stop - at) * KINDS).reshape(-1, KINDS)
            # The byte before each byte of a slice, also of the first one.
            before = np.concatenate([_KIND[raw[low - 1:low]] if low else [3], kind[:-1]])
            starts = offsets[at:stop]
            before[starts[(starts >= low) & (starts < high)] - low] = 3
            signs[at:stop] += np.bincount(owner[_LETTER_KIND[before] & (kind == 8)], minlength=stop - at)
            capitals[at:stop] += np.bincount(owner[(kind == 1) & (before == 1)], minlength=stop - at)
        at = stop
    n_words, short, different, runs, again = (np.zeros(rows) for _ in range(5))
    for first, per_row, words in word_hashes(texts):
        last, n = first + len(per_row), len(per_row)
        owner = np.repeat(np.arange(n), per_row)
        n_words[first:last] = per_row
        different[first:last] = _different(words, owner, n)
        if len(words) > 1:
            again[first:last] = np.bincount(owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
        if len(words) >= SHINGLE:
            with np.errstate(over="ignore"):
                joined = words[:1 - SHINGLE].copy()
                for step in range(1, SHINGLE):
                    joined = mix(joined) + words[step:len(words) - SHINGLE + 1 + step]
            whole = owner[SHINGLE - 1:] == owner[:1 - SHINGLE]
            runs[first:last] = _shares(_different(joined[whole], owner[:1 - SHINGLE][whole], n), np.maximum(per_row - SHINGLE + 1, 0))
    size = np.diff(offsets)
    inked = size - kinds[:, 3] - kinds[:, 4]
    short = _shares(inked, n_words)
    letters = kinds[:, 0] + kinds[:, 1] + kinds[:, 9]
    return np.column_stack([
        _shares(kinds, size[:, None]), np.log1p(size), np.log1p(short), np.exp(-short), _shares(signs, n_words), _shares(capitals, letters),
        np.log1p(_shares(n_words, kinds[:, 5] + 1)), np.log1p(_shares(n_words, kinds[:, 4] + 1)),
        _shares(different, n_words), runs, _shares(again, n_words)])


@dataclass
class Model:
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    scale: float = 1.0
    constant: float | None = None

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return _expanded(x, self.middle, self.spread) @ self.weights

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return self.squeezed(self.strengths(features(texts)))

    def squeezed(self, strengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((strengths - self.cut) * self.scale + np.log(CUT / (1 - CUT)), -40, 40)))


def _expanded(x: np.ndarray, middle: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - middle) / spread, -LONGEST_REACH, LONGEST_REACH)
    return np.concatenate([z, z * z], axis=1)


def pairs(good: np.ndarray, bad: np.ndarray, each: int = PAIRS_EACH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Places of winners and losers: every document of the longer list meets ``each`` of the other."""
    rng = np.random.default_rng(seed)
    rounds = max(len(good), len(bad))
    winners = [rng.permutation(np.resize(rng.permutation(good), rounds)) for _ in range(each)]
    losers = [np.resize(rng.permutation(bad), rounds) for _ in range(each)]
    return np.concatenate(winners), np.concatenate(losers)


Sums = tuple[float, np.ndarray, np.ndarray]


def pair_sums(differences: np.ndarray, w: np.ndarray) -> Sums:
    """Logistic loss over winners' less losers' features, its gradient and its second derivatives."""
    at = differences @ w
    p = 1 / (1 + np.exp(np.clip(at, -40, 40)))
    return float(np.logaddexp(0, -at).sum()), -differences.T @ p, (differences * (p * (1 - p))[:, None]).T @ differences


def newton(sums: Callable[[np.ndarray], Sums], width: int, ridge: float = RIDGE, steps: int = 60) -> np.ndarray:
    """Weights of least loss, by Newton's method with halved steps; ``sums`` is asked once per point."""
    def at(w: np.ndarray) -> Sums:
        loss, gradient, hessian = sums(w)
        return loss + ridge / 2 * float(w @ w), gradient + ridge * w, hessian + ridge * np.eye(width)

    w = np.zeros(width)
    now = at(w)
    for _ in range(steps):
        step, size = np.linalg.solve(now[2], now[1]), 1.0
        after = at(w - step)
        while size > 1e-4 and after[0] > now[0]:
            size /= 2
            after = at(w - size * step)
        w, before, now = w - size * step, now[0], after
        if before - now[0] < 1e-6 * max(1.0, before):
            break
    return w


def bradley_terry(differences: np.ndarray, ridge: float = RIDGE, steps: int = 60) -> np.ndarray:
    """Weights of least logistic loss over winners' less losers' features."""
    return newton(lambda w: pair_sums(differences, w), differences.shape[1], ridge, steps)


def best_quantile(strengths: np.ndarray, high: np.ndarray) -> float:
    """The share of strengths to leave below the cut: the best mean of both labels' shares of right answers."""
    order = np.argsort(strengths, kind="stable")
    high = high[order] > 0
    below = np.concatenate([[0], np.cumsum(~high)]), np.concatenate([[0], np.cumsum(high)])
    right = below[0] / max(1, (~high).sum()) + 1 - below[1] / max(1, high.sum())
    # Of equally good cuts the middle one.
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(best[len(best) // 2]) / len(high)


def cut_at(strengths: np.ndarray, quantile: float) -> float:
    """Between the two strengths that the quantile lies between; beyond all of them for 0 and 1."""
    s, below = np.sort(strengths), round(quantile * len(strengths))
    return float(np.concatenate([[s[0] - 1], s])[below] + np.concatenate([s, [s[-1] + 1]])[below]) / 2


def celled(rows: DataFrame, n_good: int, n_bad: int) -> DataFrame:
    """One row per cell with ``rows``, an array of ``mark, id, x`` in that order."""
    rare, n_rare, n_other = (0, n_bad, n_good) if n_bad <= n_good else (1, n_good, n_bad)
    cells = max(1, -(-n_other // CELL))
    # Cells that are equal modulo ``homes`` hold the same documents of the rarer label.
    homes = min(cells, max(1, n_rare // RARE_IN_CELL))
    hashed = F.xxhash64(F.lit("cell"), F.col("id").cast("string"))
    places = F.when(F.col("mark") == rare, F.sequence(F.pmod(hashed, F.lit(homes)), F.lit(cells - 1).cast("bigint"), F.lit(homes).cast("bigint"))).otherwise(
        F.array(F.pmod(hashed, F.lit(cells)).cast("bigint")))
    return (rows.select(F.explode(places).alias("cell"), F.struct("mark", "id", "x").alias("row"))
            .groupBy("cell").agg(F.sort_array(F.collect_list("row")).alias("rows")))


def cells_sums(cells: DataFrame, model: Model) -> Callable[[np.ndarray], Sums]:
    """The sums over the pairs of all cells, one row per task to the driver."""
    middle, spread, width = model.middle, model.spread, 2 * len(NAMES)

    def sums(w: np.ndarray) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + width + width * width)
            for batch in batches:
                for cell, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                    marks, _, x = rows.values.flatten()
                    marks = np.asarray(marks)
                    z = _expanded(np.asarray(x.flatten()).reshape(len(marks), -1), middle, spread)
                    good, bad = np.flatnonzero(marks > 0), np.flatnonzero(marks == 0)
                    if len(good) and len(bad):
                        winners, losers = pairs(good, bad, seed=SEED + cell)
                        loss, gradient, hessian = pair_sums(z[winners] - z[losers], w)
                        total += np.concatenate([[loss], gradient, hessian.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

        got = cells.select("cell", "rows").mapInArrow(run, "sums array<double>").toArrow()
        total = np.sum(np.array(got["sums"].to_pylist(), dtype=float), axis=0)
        return float(total[0]), total[1:1 + width], total[1 + width:].reshape(width, width)

    return sums


def best_cut(strengths: DataFrame, n_low: int, n_high: int) -> float:
    """``cut_at`` of ``best_quantile`` over ``mark, id, strength``, by running counts over ranges of strengths."""
    # Both counts in one number: rows in the lower half, those of the high label in the upper one.
    both = strengths.select(F.lit(0).alias("all"), "strength", "id", (F.lit(1) + F.shiftleft(F.col("mark").cast("bigint"), 32)).alias("both"))
    ranked = range_sum_before(both, ["all"], ["strength", "id"], "both", "before").select(
        "strength", F.col("before").bitwiseAND(F.lit((1 << 32) - 1)).alias("below"), F.shiftright("before", 32).alias("high"))
    # Rows of the low label below a cut before this row are right, those of the high label wrong.
    ranked = stored(ranked.withColumn("gain", (F.col("below") - F.col("high")) * n_high - F.col("high") * n_low), "op11-cuts")
    n, top = n_low + n_high, ranked.agg(F.max("gain")).first()[0]
    best = ranked.filter(F.col("gain") == top)
    held = best.count()
    # Of equally good cuts the middle one; the cut beyond all rows has no gain.
    middle = (held + (top == 0)) // 2
    k = n if middle == held else best.select("below").orderBy("below").offset(middle).limit(1).first()[0]
    near = {r.below: r.strength for r in ranked.filter(F.col("below").isin(k - 1, k)).select("below", "strength").collect()}
    low, high = near.get(k - 1), near.get(k)
    return ((high - 1 if low is None else low) + (low + 1 if high is None else high)) / 2


def fit(rows: DataFrame) -> Model:
    """From ``mark, later, id, x``: labels, which rows only choose the quantile, ids and features; both labels are there."""
    n = {(r.mark, r.later): r.n for r in rows.groupBy("mark", "later").agg(F.count("*").alias("n")).collect()}

    def part(later: bool) -> tuple[DataFrame, int, int]:
        """The rows of one part with the numbers of both labels, or all rows if it lacks a label."""
        good, bad = n.get((1, later), 0), n.get((0, later), 0)
        if good and bad:
            return rows.filter(F.col("later") == later), good, bad
        return rows, n.get((1, True), 0) + n.get((1, False), 0), n.get((0, True), 0) + n.get((0, False), 0)

    learn, good, bad = part(False)
    width = len(NAMES)
    found = learn.agg(*[F.avg(F.col("x")[i]) for i in range(width)], *[F.stddev_pop(F.col("x")[i]) for i in range(width)]).first()
    middle, spread = np.array(found[:width], dtype=float), np.array(found[width:], dtype=float)
    model = Model(middle, np.where(spread > 1e-9, spread, 1.0), np.zeros(0))
    model.weights = newton(cells_sums(stored(celled(learn, good, bad), "op11-cells"), model), 2 * width)
    judged, high, low = part(True) if n.get((1, True)) and n.get((0, True)) else (learn, good, bad)

    def strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(model.strengths(x))], names=["mark", "id", "strength"])

    id_type = rows.schema["id"].dataType.simpleString()
    model.cut = best_cut(judged.select("mark", "id", "x").mapInArrow(strong, f"mark int, id {id_type}, strength double"), low, high)
    return model


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, may_learn: Column | None = None) -> Model:
    """``labels`` has ``key`` and ``label`` (0 or 1); ``may_learn`` is a condition on the key."""
    marks, texts = (df.filter(F.col(key).isNotNull()) for df in (labels.filter(F.col(label).isin(0, 1)), docs))
    if may_learn is not None:
        marks, texts = marks.filter(may_learn), texts.filter(may_learn)
    marks = marks.groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("mark"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(features(part.column(1))), pa.list_(pa.float64()))], names=["id", "x"])

    # Features are taken before the join, so that no text is shuffled.
    id_type = docs.schema[key].dataType.simpleString()
    taken = texts.select(key, text).mapInArrow(measured, f"id {id_type}, x array<double>")
    later = F.pmod(F.xxhash64(F.lit("quantile"), F.col("id").cast("string")), F.lit(HELD_BACK)) == 0
    rows = stored(taken.join(marks, "id").groupBy("id", "mark").agg(F.min("x").alias("x")).select("mark", later.alias("later"), "id", "x"), "op11-rows")
    n = {r.mark: r.n for r in rows.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), constant=n.get(1, 0) / max(1, sum(n.values())))
    return fit(rows)


def score(docs: DataFrame, keep: list[str], text: str, model: Model) -> DataFrame:
    """``keep`` columns with ``score`` and ``predicted``, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(column: pa.Array) -> list[pa.Array]:
        scores = shared.value.scores(column)
        return [pa.array(scores), pa.array((scores >= CUT).astype(np.int32))]

    return with_values(docs, keep, text, "score double, predicted int", of)
