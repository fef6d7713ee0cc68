"""Quality classifier: a generalised additive model with pairwise interactions.

Training goes round the features again and again; each visit fits one shallow tree to the
gradient of the log loss and adds a small part of it to the feature's table. Then the pairs of
features that explain most of what is left get tables over both their bins. A score is the sum
of looked-up values, one per table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescout.llm.texts import fold, labelled_sample, text_chunks, words_of

#: Labelled rows the model is fitted on, at most.
SAMPLE_ROWS = 20_000

FEATURES = [
    "log_words", "word_length", "upper", "symbols", "digits", "marks", "beyond_ascii", "neighbours_equal",
    "distinct_words", "repeated_grams", "short_words", "symbol_ends", "line_words", "repeated_lines",
]

_UPPER = np.zeros(256, np.float32)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1
_SYMBOL = np.zeros(256, np.float32)
_SYMBOL[list(b"#*$%&|<>{}[]\\~^=+_@!")] = 1
_DIGIT = np.zeros(256, np.float32)
_DIGIT[48:58] = 1
_MARK = np.zeros(256, np.float32)
_MARK[list(b".,;:?'\"-()")] = 1
_HIGH = np.zeros(256, np.float32)
_HIGH[0xC0:] = 1
_NEWLINE = np.zeros(256, np.float32)
_NEWLINE[10] = 1


def _repeats(value: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Per text: entries whose value was seen before in the text."""
    if not value.size:
        return np.zeros(n)
    order = np.lexsort((value, text))
    v, t = value[order], text[order]
    again = (v[1:] == v[:-1]) & (t[1:] == t[:-1])
    return np.bincount(t[1:][again], minlength=n).astype(float)


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of ``FEATURES`` per text, from the whole text."""
    n = len(texts)
    w = words_of(texts)
    size = np.fromiter((len(t or b"") for t in texts), np.int64, n)
    stop = np.cumsum(size + 1)
    begin = stop - size - 1

    def per_text(table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[w.data], begin) - table[10]

    words = np.diff(w.first).astype(float)
    some, chars = np.maximum(words, 1), np.maximum(size, 1)
    same = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1]))
    gram, place = w.grams(5)
    lines = [[x for x in (t or b"").split(b"\n") if x.strip()] for t in texts]
    length = w.end - w.start
    out = np.column_stack([
        np.log1p(words),
        np.bincount(w.text, length, n) / some,
        per_text(_UPPER) / np.maximum(per_text(_LETTER), 1),
        per_text(_SYMBOL) / chars,
        per_text(_DIGIT) / chars,
        per_text(_MARK) / some,
        per_text(_HIGH) / chars,
        np.bincount(w.text[same], minlength=n) / some,
        1 - _repeats(w.hash, w.text, n) / some,
        _repeats(gram, w.text[place], n) / some,
        np.bincount(w.text[length <= 3], minlength=n) / some,
        np.bincount(w.text[_SYMBOL[w.data[w.end - 1]] > 0], minlength=n) / some,
        words / np.maximum([len(x) for x in lines], 1),
        np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines]),
    ])
    return out.astype(np.float32)


@dataclass
class AdditiveModel:
    """Cuts and tables of a fitted model; plain arrays, so it travels inside a task."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best place to split ordered bins, by the gain of two Newton steps over one."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    at = int(np.argmax(gain)) if gain.size else 0
    return (float(gain[at]) if gain.size else 0.0), at + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Newton steps of a tree with up to three leaves over ordered bins."""
    _, at = _cut(g, h, ridge)
    spans = [(0, at), (at, g.size)] if g.size > 1 else [(0, g.size)]
    gains = [_cut(g[a:b], h[a:b], ridge) for a, b in spans]
    k = int(np.argmax([x[0] for x in gains]))
    if gains[k][0] > 0:
        a, b = spans[k]
        spans[k : k + 1] = [(a, a + gains[k][1]), (a + gains[k][1], b)]
    step = np.empty(g.size)
    for a, b in spans:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """A tree of two levels over a grid: rows are cut once, each part's columns once."""
    best, step = 0.0, np.zeros_like(g)
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for at in range(1, g.shape[0]):
        gain, trial = -whole, np.empty_like(g)
        for rows in (slice(0, at), slice(at, None)):
            gr, hr = g[rows].sum(0), h[rows].sum(0)
            _, cut = _cut(gr, hr, ridge)
            for cols in (slice(0, cut), slice(cut, None)):
                s, t = gr[cols].sum(), hr[cols].sum()
                gain += s * s / (t + ridge)
                trial[rows, cols] = s / (t + ridge)
        if gain > best:
            best, step = gain, trial
    return best, step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, pairs: int = 4, bins: int = 32, rate: float = 0.1, ridge: float = 1.0) -> AdditiveModel:
    """Cyclic boosting of the feature tables, then of the strongest pairs. One class gives a constant."""
    model = AdditiveModel()
    if not len(y):
        return model
    rate_of_one = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(rate_of_one / (1 - rate_of_one)))
    if y.min() == y.max():
        return model
    d = x.shape[1]
    model.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    model.coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 9)[1:-1])) for j in range(d)]
    model.tables = [np.zeros(c.size + 1) for c in model.cuts]
    place = [np.searchsorted(model.cuts[j], x[:, j], side="right") for j in range(d)]
    wide = [np.searchsorted(model.coarse[j], x[:, j], side="right") for j in range(d)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            k = model.tables[j].size
            step = rate * _tree(np.bincount(place[j], g, k), np.bincount(place[j], h, k), ridge)
            model.tables[j] += step
            total += step[place[j]]
    g, h = slopes()
    grids = {}
    for a in range(d):
        for b in range(a + 1, d):
            shape = (model.coarse[a].size + 1, model.coarse[b].size + 1)
            cell = wide[a] * shape[1] + wide[b]
            sums = [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]
            grids[a, b] = (_pair_tree(*sums, ridge)[0], cell, shape)
    chosen = sorted(grids, key=lambda ab: -grids[ab][0])[:pairs]
    tables = {ab: np.zeros(grids[ab][2]) for ab in chosen}
    for _ in range(pair_rounds):
        for ab in chosen:
            g, h = slopes()
            _, cell, shape = grids[ab]
            sums = [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]
            step = rate * _pair_tree(*sums, ridge)[1]
            tables[ab] += step
            total += step.ravel()[cell]
    model.pairs = [(a, b, tables[a, b]) for a, b in chosen]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, folds: int = 5) -> AdditiveModel:
    """Fits the model on at most ``rows`` labelled documents outside fold 0.

    Only feature rows come to the driver, ``rows`` times 14 numbers at most.
    """
    sample = labelled_sample(docs, labels, label, rows, folds)
    names = [f"f{j}" for j in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            x = features(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["doc_id", "label", *names])

    kind = sample.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{n} float" for n in names)
    got = sample.mapInArrow(run, f"doc_id {kind}, label int, {fields}").toPandas()
    # Rows arrive in any order; sums of floats should not depend on it.
    got = got.sort_values(["doc_id", *names], kind="stable")
    return fit(got[names].to_numpy(np.float32), (got["label"].to_numpy() > 0).astype(float))


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, keep: bool = False) -> DataFrame:
    """``doc_id, score, predicted`` per row; with ``keep``, all columns of ``docs`` besides.

    NULL and empty texts are scored as texts without words. Repeated rows are scored alike. Added
    columns replace columns of ``docs`` of the same names.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")] if keep else ["doc_id"]
    rows = docs.select(F.struct(*names).alias("row"), F.col("text").cast("string").alias("_text"))
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("score double, predicted int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "_text"):
            score = model.score(features(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["row", "score", "predicted"]
            )

    return rows.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in names], "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; a NULL id is not held out."""
    model = train(docs, labels, folds=folds)
    held = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False))
    return score_quality(docs, model, threshold).select("doc_id", held.alias("held_out"), "score", "predicted")
