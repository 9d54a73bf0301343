"""Language identification in two steps: the family first, then the language within it.

A text is the share of each of its byte n-grams (1 to 3 bytes of the lower-cased
text), hashed to 8,192 cells. Linear support vector machines, one against the
rest, choose the family; within a family of several languages, one-versus-one
machines of the languages choose among those alone. A linear score is a mean over n-grams,
so whole texts of any length are scored in slices.

These machines only compare learned languages. Whether a text is in any of them is
judged by itself: by the share of its letter trigrams that at least two learned
texts of one language have. The bound of a language is found on rows that the trigrams
were not taken from, and is at most ``LEAST_KNOWN``.

Defined cases: null, empty and letterless texts are ``und`` with score 0; a
language that ``FAMILIES`` doesn't name is a family of its own; with nothing to
learn from, every text is ``und``; a null language is not learned from; a language of too few
rows to know its trigrams has the bound 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_values
from .sampling import labelled_sample

CELLS = 8192
UNKNOWN = "und"
PER_LANGUAGE = 400
SLICE = 1 << 18
KNOWN_CELLS = 1 << 18
#: Held-out texts of sf0.01 and sf0.1 have 0.81 or more, a Dutch one 0.60, the other languages tried and random letters less.
LEAST_KNOWN = 0.65
_LETTERS = re.compile(r"[^\W\d_]+")

#: Families of languages.
FAMILIES: dict[str, tuple[str, ...]] = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "indic": ("bn", "gu", "hi", "mr", "pa", "ur"),
}


def _grams(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Cells of the 1- to 3-grams that start at each byte but the last two, with their length."""
    a = raw[:-2].astype(np.uint32)
    b = a << 8 | raw[1:-1]
    c = b << 8 | raw[2:]
    for n, code in ((1, a), (2, b), (3, c)):
        code = (code + np.uint32(n)) * np.uint32(2654435761)
        yield n, (code >> np.uint32(19)).astype(np.int32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def prepared(text: str) -> bytes:
    """The bytes that are scored; the padding closes the last n-grams and belongs to no text."""
    return b" " + text.lower().encode("utf-8", "replace") + b" \0\0"


def features(text: str) -> np.ndarray:
    """Shares of the n-grams of one text."""
    raw = np.frombuffer(prepared(text), dtype=np.uint8)
    out = np.zeros(CELLS)
    for at in range(0, len(raw) - 2, SLICE):
        for _, cells in _grams(raw[at:at + SLICE + 2]):
            out += np.bincount(cells, minlength=CELLS)
    return out / (3 * (len(raw) - 2))


def trigrams(text: str) -> np.ndarray:
    """Cells of the trigrams of the letters of one text; all else only parts words."""
    raw = np.frombuffer(" ".join(["", *_LETTERS.findall(text.lower()), ""]).encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    return (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761) >> np.uint32(14)


def _known_cells(cells: list[np.ndarray]) -> np.ndarray:
    """Cells that at least two texts have, from the distinct ones of each."""
    return np.bincount(np.concatenate([*cells, np.zeros(0, dtype=np.uint32)]), minlength=KNOWN_CELLS) >= 2


def fit_known(rows: list[tuple[str, str]]) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Known trigrams of each language, and the bound that all but a hundredth of its rows pass, each half judged by the other."""
    known, bounds = {}, {}
    for lang in {lang for _, lang in rows}:
        listed = [trigrams(t) for t, other in rows if other == lang]
        distinct = [np.unique(x) for x in listed]
        halves = [_known_cells(distinct[i::2]) for i in (0, 1)]
        shares = sorted(halves[1 - i % 2][x].mean() for i, x in enumerate(listed))
        known[lang], bounds[lang] = _known_cells(distinct), min(LEAST_KNOWN, float(shares[len(shares) // 100]))
    return known, bounds


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, passes: int = 30, seed: int = 7) -> np.ndarray:
    """Weights and bias (last) of a linear support vector machine by dual coordinate descent; ``y`` is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    weights, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    norms = (x.astype(float) ** 2).sum(axis=1)
    # Both sides weigh the same however many rows they have.
    most = c * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            gradient = y[i] * (x[i] @ weights) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), most[i])
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return weights


@dataclass
class Model:
    """``machines`` has a row of weights per machine; a machine is (group, language or family it speaks for)."""

    families: dict[str, list[str]] = field(default_factory=dict)
    machines: dict[tuple[str, ...], int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, CELLS), dtype=np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    known: dict[str, np.ndarray] = field(default_factory=dict)
    bounds: dict[str, float] = field(default_factory=dict)

    def recognised(self, text: str, language: str) -> bool:
        """Whether a text is in the language predicted for it, or in another learned one: a short text's prediction may miss."""
        if not self.known:
            return False
        cells = trigrams(text)
        if self.known[language][cells].mean() >= self.bounds[language]:
            return True
        return any(known[cells].mean() >= LEAST_KNOWN for known in self.known.values())

    def predict(self, margins: np.ndarray) -> tuple[str, float]:
        """Language and probability from one margin per machine."""
        if not self.families:
            return UNKNOWN, 0.0
        names = sorted(self.families)
        family, score = names[0], 1.0
        if len(names) > 1:
            family, score = _best({f: margins[self.machines["family", f]] for f in names})
        inside = self.families[family]
        if len(inside) == 1:
            return inside[0], score
        votes = dict.fromkeys(inside, 0.0)
        for i, a in enumerate(inside):
            for b in inside[i + 1:]:
                margin = np.tanh(margins[self.machines["pair", a, b]])
                votes[a] += margin
                votes[b] -= margin
        language, share = _best(votes)
        return language, score * share


def _best(margins: Mapping[str, float]) -> tuple[str, float]:
    top = max(margins, key=lambda k: (margins[k], k))
    return top, float(1 / sum(np.exp(3 * (m - margins[top])) for m in margins.values()))


def fit(rows: list[tuple[str, str]], families: Mapping[str, tuple[str, ...]] = FAMILIES) -> Model:
    """A model from (text, language) rows; texts without letters teach nothing."""
    rows = [(t, lang) for t, lang in rows if lang is not None and has_letter(t)]
    if not rows:
        return Model()
    family_of = {lang: f for f, langs in families.items() for lang in langs}
    x = np.array([features(t) for t, _ in rows], dtype=np.float32)
    langs = np.array([lang for _, lang in rows])
    homes = np.array([family_of.get(lang, lang) for lang in langs])
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-6)
    x *= scale
    model = Model({f: sorted(set(langs[homes == f])) for f in set(homes)})
    rows_of, weights = model.machines, []

    def add(key: tuple[str, ...], chosen: np.ndarray, positive: np.ndarray) -> None:
        rows_of[key] = len(weights)
        weights.append(fit_svm(x[chosen], np.where(positive[chosen], 1.0, -1.0)))

    every = np.ones(len(rows), dtype=bool)
    if len(model.families) > 1:
        for family in sorted(model.families):
            add(("family", family), every, homes == family)
    for inside in model.families.values():
        for i, a in enumerate(inside):
            for b in inside[i + 1:]:
                add(("pair", a, b), (langs == a) | (langs == b), langs == a)
    if weights:
        stack = np.array(weights)
        model.weights, model.bias = (stack[:, :-1] * scale).astype(np.float32), stack[:, -1]
    model.known, model.bounds = fit_known(rows)
    return model


def margins(model: Model, texts: list[str]) -> np.ndarray:
    """One row per text, one column per machine."""
    packed = [prepared(t) for t in texts]
    sizes = np.array([len(p) for p in packed])
    out = np.zeros((len(texts), len(model.weights)))
    first = 0
    while first < len(texts):
        last, room = first + 1, SLICE - sizes[first]
        while last < len(texts) and sizes[last] <= room:
            room -= sizes[last]
            last += 1
        raw = np.frombuffer(b"".join(packed[first:last]), dtype=np.uint8)
        ends = np.cumsum(sizes[first:last])
        starts = ends - sizes[first:last]
        for at in range(0, len(raw) - 2, SLICE):
            cells = [c for _, c in _grams(raw[at:at + SLICE + 2])]
            inside = np.clip(starts - at, 0, len(cells[0])), np.clip(ends - 2 - at, 0, len(cells[0]))
            for m, weights in enumerate(model.weights):
                per_byte = weights[cells[0]] + weights[cells[1]] + weights[cells[2]]
                so_far = np.concatenate([[0.0], np.cumsum(per_byte, dtype=np.float64)])
                out[first:last, m] += so_far[inside[1]] - so_far[inside[0]]
        first = last
    return out / (3 * (sizes - 2))[:, None] + model.bias


def learn(docs: DataFrame, key: str, text: str, lang: str, per_language: int = PER_LANGUAGE) -> Model:
    """Fits on at most ``per_language`` documents of each language."""
    sample = labelled_sample(docs.select(key, text, lang), key, lang, per_language)
    return fit([(r[0], r[1]) for r in sample.select(text, lang).orderBy(lang, F.xxhash64(text), text).toLocalIterator()])


def predict(docs: DataFrame, keep: list[str], text: str, model: Model, reject: bool = False) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``, from the text alone.

    With ``reject``, texts in none of the learned languages are ``und`` too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(column: pa.Array) -> list[pa.Array]:
        texts = column.to_pylist()
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        found = [(UNKNOWN, 0.0)] * len(texts)
        for i, row in zip(known, margins(shared.value, [texts[i] for i in known]), strict=True):
            best = shared.value.predict(row)
            if not reject or shared.value.recognised(texts[i], best[0]):
                found[i] = best
        return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

    return with_values(docs, keep, text, "lang_pred string, score double", of, rows=128)
