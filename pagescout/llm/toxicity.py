"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Every word enters by two ways: as a word (an embedding by hash and how often the word stood in
toxic training texts) and as characters (the mean embedding of its letter trigrams). Windows of
32 words that overlap by 8 cover the whole text; the score of a text comes from its worst
window and the number of windows. Texts have labels, windows have none, so training goes back
and forth: score all windows, then learn from the worst window of each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescout.llm.texts import ALNUM, Words, fold, labelled_sample, mix, text_chunks, words_of

#: Labelled rows the network is fitted on, at most.
SAMPLE_ROWS = 4_000
WINDOW, STRIDE = 32, 24
HIDDEN, WIDE, SLOTS = 8, 6, 4096
#: Windows taken through the network at one time.
BATCH = 2048


@dataclass
class Priors:
    """Log odds of toxic texts among the training texts that have a word; sorted by word hash."""

    word: np.ndarray
    odds: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not self.word.size:
            return np.zeros(hashes.size, np.float32)
        at = np.minimum(np.searchsorted(self.word, hashes), self.word.size - 1)
        return np.where(self.word[at] == hashes, self.odds[at], 0).astype(np.float32)


def priors(w: Words, y: np.ndarray, rows: np.ndarray, weight: float = 3.0) -> Priors:
    """Priors from the texts ``rows``; words of fewer than three texts say nothing."""
    mine = np.isin(w.text, rows)
    word, inverse = np.unique(w.hash[mine], return_inverse=True)
    if not y.size:
        return Priors(word, np.empty(0, np.float32))
    pairs = np.unique(inverse * y.size + w.text[mine])
    seen = np.bincount(pairs // y.size, minlength=word.size)
    bad = np.bincount(pairs // y.size, y[pairs % y.size], word.size)
    rate = np.clip(y[rows].mean() if rows.size else 0.5, 0.01, 0.99)
    p = (bad + weight * rate) / (seen + weight)
    odds = np.log(p / (1 - p)) - np.log(rate / (1 - rate))
    tell = (seen >= 3) & (np.abs(odds) > 0.3)
    return Priors(word[tell], np.clip(odds[tell] / 3, -1, 1).astype(np.float32))


@dataclass
class Vocabulary:
    """The different words of some texts and their letter trigrams, as slots of the embeddings."""

    word: np.ndarray
    inverse: np.ndarray
    slot: np.ndarray
    gram: np.ndarray
    owner: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, w: Words) -> Vocabulary:
        word, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        start, length = w.start[first], w.end[first] - w.start[first]
        # Trigrams of "<word>": as many as the word has bytes.
        owner = np.repeat(np.arange(word.size), length)
        place = np.arange(owner.size) - np.repeat(np.cumsum(length) - length, length)
        at = np.repeat(start, length) + place
        here = w.data[at].astype(np.uint64)
        before = np.where(place == 0, 1, w.data[np.maximum(at - 1, 0)]).astype(np.uint64)
        after = np.where(place == np.repeat(length, length) - 1, 2, w.data[np.minimum(at + 1, w.data.size - 1)]).astype(np.uint64)
        gram = (mix(before << np.uint64(16) | here << np.uint64(8) | after) % np.uint64(SLOTS)).astype(np.int64)
        return cls(word, inverse, (word % np.uint64(SLOTS)).astype(np.int64), gram, owner, (1 / np.maximum(length, 1)).astype(np.float32))


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words, and text of every window. The last window of a text ends with it; a text without words has one empty window."""
    count = np.diff(first)
    n = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(count.size), n)
    k = np.arange(text.size) - np.repeat(np.cumsum(n) - n, n)
    offset = np.minimum(k * STRIDE, np.maximum(count[text] - WINDOW, 0))
    return first[text] + offset, np.minimum(count[text], WINDOW), text


class Network:
    """Weights, forward pass and gradients. Input of a word: word embedding, letter embedding, prior."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = 2 * WIDE + 1, HIDDEN

        def n(*shape: int, scale: float = 0.3) -> np.ndarray:
            return (r.standard_normal(shape) * scale).astype(np.float32)

        self.p = {
            "word": n(SLOTS, WIDE, scale=0.1), "gram": n(SLOTS, WIDE, scale=0.1),
            "in": n(2, d, 3 * h), "rec": n(2, h, 3 * h), "bias": np.zeros((2, 3 * h), np.float32),
            "attend": n(2 * h), "out": n(2 * h), "base": np.zeros(1, np.float32),
        }
        self.calibration = np.array([0.0, 1.0, 0.0])

    def inputs(self, v: Vocabulary, odds: np.ndarray) -> np.ndarray:
        letters = np.zeros((v.word.size, WIDE), np.float32)
        if v.gram.size:
            # Words own their trigrams one after the other, and each has at least one.
            start = np.flatnonzero(np.diff(v.owner, prepend=-1))
            letters = np.add.reduceat(self.p["gram"][v.gram], start) * v.share[:, None]
        return np.concatenate([self.p["word"][v.slot], letters, odds[:, None] * 2], 1)

    def forward(self, projected: np.ndarray, words: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows; ``projected`` is the input of each word times the input weights, both ways."""
        b, t, h = words.shape[0], words.shape[1], HIDDEN
        states = np.zeros((t, b, 2 * h), np.float32)
        real = np.arange(t)[:, None] < size
        trace = []
        for way in (0, 1):
            u = self.p["rec"][way]
            s = np.zeros((b, h), np.float32)
            for k in range(t) if way == 0 else range(t - 1, -1, -1):
                x = projected[words[:, k], way]
                gates = 1 / (1 + np.exp(-(x[:, : 2 * h] + s @ u[:, : 2 * h])))
                z, r = gates[:, :h], gates[:, h:]
                rs = r * s
                c = np.tanh(x[:, 2 * h :] + rs @ u[:, 2 * h :])
                new = np.where(real[k][:, None], z * s + (1 - z) * c, s)
                if keep:
                    trace.append((way, k, s, z, r, c))
                s = states[k, :, way * h : (way + 1) * h] = new
        raw = np.where(real, states @ self.p["attend"], -1e9)
        raw[0] = np.where(size == 0, 0, raw[0])
        weight = np.exp(raw - raw.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        logit = pooled @ self.p["out"] + self.p["base"][0]
        return (logit, (states, weight, pooled, real, trace)) if keep else logit

    def gradients(self, v: Vocabulary, odds: np.ndarray, words: np.ndarray, size: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over some windows."""
        h, p = HIDDEN, self.p
        x = self.inputs(v, odds)
        projected = np.stack([x @ p["in"][w] + p["bias"][w] for w in (0, 1)], 1)
        logit, (states, weight, pooled, real, trace) = self.forward(projected, words, size, keep=True)
        g = {k: np.zeros_like(a) for k, a in p.items()}
        d_logit = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        g["base"][0] = d_logit.sum()
        g["out"] = pooled.T @ d_logit
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = (states * d_pooled).sum(2)
        d_raw = weight * (d_weight - (weight * d_weight).sum(0)) * real
        d_states = weight[:, :, None] * d_pooled + d_raw[:, :, None] * p["attend"]
        g["attend"] = np.einsum("tb,tbh->h", d_raw, states)
        d_projected = np.zeros_like(projected)
        carry = {0: np.zeros((len(y), h), np.float32), 1: np.zeros((len(y), h), np.float32)}
        for way, k, s, z, r, c in reversed(trace):
            u = p["rec"][way]
            d_new = d_states[k, :, way * h : (way + 1) * h] + carry[way]
            on = real[k][:, None]
            dz = d_new * (s - c) * z * (1 - z) * on
            dc = d_new * (1 - z) * (1 - c * c) * on
            d_rs = dc @ u[:, 2 * h :].T
            dr = d_rs * s * r * (1 - r)
            d_gates = np.concatenate([dz, dr], 1)
            carry[way] = np.where(on, d_new * z + d_rs * r + d_gates @ u[:, : 2 * h].T, d_new)
            g["rec"][way][:, : 2 * h] += s.T @ d_gates
            g["rec"][way][:, 2 * h :] += (r * s).T @ dc
            np.add.at(d_projected[:, way], words[:, k], np.concatenate([d_gates, dc], 1))
        d_x = np.zeros_like(x)
        for w in (0, 1):
            g["in"][w] = x.T @ d_projected[:, w]
            g["bias"][w] = d_projected[:, w].sum(0)
            d_x += d_projected[:, w] @ p["in"][w].T
        np.add.at(g["word"], v.slot, d_x[:, :WIDE])
        np.add.at(g["gram"], v.gram, (d_x[:, WIDE : 2 * WIDE] * v.share[:, None])[v.owner])
        return g

    def window_logits(self, v: Vocabulary, odds: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        x = self.inputs(v, odds)
        projected = np.stack([x @ self.p["in"][w] + self.p["bias"][w] for w in (0, 1)], 1)
        if not v.inverse.size:
            projected = np.zeros((1, 2, 3 * HIDDEN), np.float32)
        out = np.empty(start.size, np.float32)
        for a in range(0, start.size, BATCH):
            words = window_words(v, start[a : a + BATCH], size[a : a + BATCH])
            out[a : a + BATCH] = self.forward(projected, words, size[a : a + BATCH])
        return out

    def text_scores(self, worst: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Score of texts from their worst window and their number of windows."""
        a, b, c = self.calibration
        return 1 / (1 + np.exp(-np.clip(a + b * worst + c * np.log(n), -30, 30)))


def window_words(v: Vocabulary, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Vocabulary place of every word of every window; places beyond a window's end repeat a word and are masked."""
    if not v.inverse.size:
        return np.zeros((start.size, WINDOW), np.int64)
    at = start[:, None] + np.minimum(np.arange(WINDOW), np.maximum(size - 1, 0)[:, None])
    return v.inverse[np.minimum(at, v.inverse.size - 1)]


@dataclass
class ToxicityModel:
    network: Network
    priors: Priors

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """Scores of whole texts; one without words is scored as an empty window."""
        w = words_of(texts, ALNUM, lower=True)
        v = Vocabulary.of(w)
        start, size, text = windows(w.first)
        logit = self.network.window_logits(v, self.priors.of(v.word), start, size)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, text, logit)
        return self.network.text_scores(worst, np.bincount(text, minlength=len(texts)))


def _calibrate(worst: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the worst window and the logarithm of the number of windows."""
    x = np.column_stack([np.ones(y.size), worst, np.log(n)])
    beta = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(3)
        beta += np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * beta)
    return beta


def fit(texts: list[bytes], y: np.ndarray, epochs: int = 4, batch: int = 256, rate: float = 0.01, seed: int = 11) -> ToxicityModel:
    """Trains on labelled texts. Priors used in training come from the other half of the texts, so that the network doesn't trust a word it has only seen in the text at hand."""
    net = Network()
    w = words_of(texts, ALNUM, lower=True)
    everything = priors(w, y, np.arange(y.size))
    if not y.size or y.min() == y.max():
        net.calibration = np.array([np.log((y.sum() + 0.5) / (y.size - y.sum() + 0.5)) if y.size else -2.0, 0.0, 0.0])
        return ToxicityModel(net, everything)
    v = Vocabulary.of(w)
    start, size, text = windows(w.first)
    n = np.bincount(text, minlength=y.size)
    half = np.arange(y.size) % 2
    odds = [priors(w, y, np.flatnonzero(half != k)).of(v.word) for k in (0, 1)]
    random = np.random.default_rng(seed)
    first = np.zeros((2, start.size), np.float32)
    for k in (0, 1):
        for a in range(0, start.size, BATCH):
            first[k, a : a + BATCH] = odds[k][window_words(v, start[a : a + BATCH], size[a : a + BATCH])].max(1)
    value = first[half[text], np.arange(text.size)]
    moments = {k: [np.zeros_like(a), np.zeros_like(a)] for k, a in net.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch:
            value = np.empty(start.size, np.float32)
            for k in (0, 1):
                mine = np.flatnonzero(half[text] == k)
                value[mine] = net.window_logits(v, odds[k], start[mine], size[mine])
        order = np.lexsort((value, text))
        worst = order[np.cumsum(n) - 1]
        clean = np.flatnonzero(y[text] == 0)
        chosen = np.concatenate([worst, random.choice(clean, min(clean.size, y.size), replace=False)])
        random.shuffle(chosen)
        for k, part in [(k, part) for a in range(0, chosen.size, 2 * batch) for k in (0, 1) for part in [chosen[a : a + 2 * batch]]]:
            mine = part[half[text[part]] == k]
            if not mine.size:
                continue
            words = window_words(v, start[mine], size[mine])
            used, local = np.unique(words, return_inverse=True)
            small = _restrict(v, used)
            g = net.gradients(small, odds[k][used], local.reshape(words.shape), size[mine], y[text[mine]].astype(np.float32))
            step += 1
            for name, d in g.items():
                m, q = moments[name]
                m += 0.1 * (d - m)
                q += 0.001 * (d * d - q)
                net.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-7)
    value = np.empty(start.size, np.float32)
    for k in (0, 1):
        mine = np.flatnonzero(half[text] == k)
        value[mine] = net.window_logits(v, odds[k], start[mine], size[mine])
    worst = np.full(y.size, -np.inf)
    np.maximum.at(worst, text, value)
    net.calibration = _calibrate(worst, n, y)
    return ToxicityModel(net, everything)


def _restrict(v: Vocabulary, used: np.ndarray) -> Vocabulary:
    """The vocabulary of some of its words, given in order."""
    new = np.full(v.word.size, -1)
    new[used] = np.arange(used.size)
    mine = new[v.owner] >= 0
    return Vocabulary(v.word[used], np.empty(0, np.int64), v.slot[used], v.gram[mine], new[v.owner[mine]], v.share[used])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, folds: int = 5) -> ToxicityModel:
    """Trains on at most ``rows`` labelled documents outside fold 0, collected as whole texts."""
    got = labelled_sample(docs, labels, "toxic", rows, folds).toPandas().sort_values(["doc_id", "text"], kind="stable")
    return fit([(t or "").encode() for t in got["text"]], (got["label"].to_numpy() > 0).astype(float))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` per row, from all windows of the whole text.

    NULL and empty texts get the score of a text without words. Rows are scored one by one, so
    repeated rows and NULL ids come out as they went in; other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(texts).astype(float))], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; a NULL id is not held out."""
    model = train(docs, labels, folds=folds)
    held = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
