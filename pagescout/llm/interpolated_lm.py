"""A language model by deleted interpolation of bigram, unigram and uniform estimates.

P(w | u) = l2 c(u w) / c(u) + l1 c(w) / N + l0 / (V + 1); the weights depend on how often the
context u was seen, by powers of two. They are learned by expectation-maximisation on all
training documents, each against counts from which its own have been deleted.

Counts cover the whole training part and are never brought together in one place. Documents are
dealt to chunks of a few MB within the partition that reads them. A chunk asks for the counts of its different words and bigrams, as
64-bit hashes that are dealt to blocks by value; a block adds up what all chunks have seen of
each and answers every chunk in the order of its question. A frequent word costs one entry a chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescout.llm.texts import SPACED, binary, fold, mix, words_of
from pagescout.storage import materialize_bucketed

#: Text of a chunk on average, and different words and bigrams of a block about; bytes and entries.
CHUNK, BLOCK = 8 << 20, 2_000_000
#: Chunks of a bucket, which one task reads, and most buckets that a table may have (Spark's own bound).
CHUNKS_PER_TASK, MOST_BUCKETS = 8, 100_000
#: Weights are learned per power of two of the context's count, on estimates in steps of 1 / 4 of a power of two.
BUCKETS, STEPS = 24, 160
_END, _START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)


@dataclass
class Tokens:
    """Tokens of the texts of a chunk: place of each in the sorted different words and bigrams."""

    text: np.ndarray
    size: np.ndarray
    word: np.ndarray
    words: np.ndarray
    pair: np.ndarray
    pairs: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Tokens:
        w = words_of(texts, SPACED, lower=True)
        n = len(texts)
        size = np.diff(w.first) + 1
        tokens = np.full(int(size.sum()), _END)
        tokens[np.arange(w.hash.size) + w.text] = w.hash
        first = np.cumsum(size) - size
        before = np.roll(tokens, 1)
        before[first] = _START
        words, word = np.unique(tokens, return_inverse=True)
        pairs, pair = np.unique(mix(before * np.uint64(0x9FB21C651E98DF25) + tokens), return_inverse=True)
        return cls(np.repeat(np.arange(n), size), size, word, words, pair, pairs, first)


def _narrow(values: np.ndarray) -> bytes:
    """Counts in the fewest bytes each that hold the largest, behind one byte that tells how many."""
    width = next(w for w in (1, 2, 4, 8) if not values.size or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _packed(keys: np.ndarray) -> bytes:
    """Rising 64-bit keys: the first, then their distances, byte by byte, without the bytes that are zero in all of them."""
    gaps = np.diff(keys)
    width = (int(gaps.max()).bit_length() + 7) // 8 if gaps.size else 0
    return keys[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() + bytes([width])


def _unpacked(data: bytes) -> np.ndarray:
    first, width = np.frombuffer(data, "<u8", 1), data[-1]
    if not width:
        return first.astype(np.uint64)
    planes = np.frombuffer(data, np.uint8, offset=8, count=len(data) - 9).reshape(width, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :width] = planes.T
    return np.cumsum(np.concatenate([first, gaps.view("<u8").ravel()]), dtype=np.uint64)


def _blocks(values: np.ndarray, blocks: int) -> np.ndarray:
    """Where each block begins among sorted values, and the end."""
    high = ((values >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    return np.searchsorted(high, np.arange(blocks + 1))


def _sums(place: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Whole sums of counts by place, exact at any size."""
    out = np.zeros(size, np.int64)
    np.add.at(out, place, counts)
    return out


def _questions(chunks: DataFrame, blocks: int) -> DataFrame:
    """``block, chunk, keys, counts``: different words (blocks from 0) and bigrams (from ``blocks``) of each chunk with their training counts."""

    def ask(table: pa.Table) -> pa.Table:
        t = Tokens.of(table["text"].cast(pa.binary()).to_pylist())
        train = (~table["held_out"].to_numpy())[t.text]
        block, keys, counts = [], [], []
        for kind, (values, place) in enumerate(((t.words, t.word), (t.pairs, t.pair))):
            seen = np.bincount(place[train], minlength=values.size)
            edge = _blocks(values, blocks)
            for b in np.flatnonzero(np.diff(edge)):
                block.append(kind * blocks + int(b))
                keys.append(_packed(values[edge[b] : edge[b + 1]]))
                counts.append(_narrow(seen[edge[b] : edge[b + 1]]))
        return pa.table({"block": pa.array(block, pa.int32()), "chunk": pa.array([table["chunk"][0].as_py()] * len(block), pa.int32()), "keys": binary(keys), "counts": binary(counts)})

    return chunks.select("chunk", "text", "held_out").groupBy("chunk").applyInArrow(ask, "block int, chunk int, keys binary, counts binary")


def _answer(table: pa.Table) -> pa.Table:
    """Totals in the order of each question; a row of chunk -1 has the block's different keys and its sum."""
    keys = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
    edge = np.cumsum([0, *(k.size for k in keys)])
    different, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = _sums(place, np.concatenate([_widen(c) for c in table["counts"].to_pylist()]), different.size)
    totals = [_narrow(total[place[a:b]]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    block = table["block"][0].as_py()
    return pa.table({
        "chunk": pa.array([*table["chunk"].to_pylist(), -1], pa.int32()),
        "block": pa.array([block] * (len(keys) + 1), pa.int32()),
        "totals": binary([*totals, b""]),
        "different": pa.array([*[0] * len(keys), int((total > 0).sum())], pa.int64()),
        "seen": pa.array([*[0] * len(keys), int(total.sum())], pa.int64()),
    })


def _answer_packed(table: pa.Table) -> pa.Table:
    return _answer(table.set_column(table.column_names.index("keys"), "keys", binary([_unpacked(k) for k in table["keys"].to_pylist()])))


@dataclass
class Counts:
    """What a chunk knows of its tokens after the answers."""

    tokens: Tokens
    word: np.ndarray
    pair: np.ndarray
    context: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, answers: pa.Table, blocks: int, train_texts: int) -> Counts:
        t = Tokens.of(table["text"].cast(pa.binary()).to_pylist())
        order = np.argsort(answers["block"].to_numpy(), kind="stable")
        parts, block = answers["totals"].to_pylist(), answers["block"].to_numpy()
        none = [np.empty(0, np.int64)]
        word = np.concatenate(none + [_widen(parts[i]) for i in order if block[i] < blocks])[t.word]
        pair = np.concatenate(none + [_widen(parts[i]) for i in order if block[i] >= blocks])[t.pair]
        context = np.roll(word, 1)
        context[t.first] = train_texts
        return cls(t, word, pair, context)

    def without_own(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of word, bigram and context without those of the token's own text."""
        t = self.tokens

        def own(place: np.ndarray, different: int) -> np.ndarray:
            key = t.text * different + place
            _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
            return n[inverse]

        of_word = own(t.word, t.words.size)
        of_context = np.roll(of_word, 1)
        of_context[t.first] = 1
        # Texts that are held out are in no count; what comes out for them is not used.
        return tuple(np.maximum(x, 0) for x in (self.word - of_word, self.pair - own(t.pair, t.pairs.size), self.context - of_context))


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)


def _steps(p: np.ndarray) -> np.ndarray:
    """Estimates as steps below 1; 0 stands for none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, STEPS - np.minimum(np.round(-4 * np.log2(np.maximum(p, 1e-300))), STEPS - 1), 0).astype(np.int64)


def learn_weights(cells: list[tuple[int, int, int, int]], uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights of bigram, unigram and uniform estimates per bucket, from counts of ``(bucket, bigram step, unigram step)``."""
    out = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    out[0] = [0.0, 0.8, 0.2]
    if not cells:
        return out
    data = np.array(sorted(cells), np.int64)
    value = lambda s: np.where(s > 0, 2.0 ** ((s - STEPS) / 4), 0.0)
    estimates = np.column_stack([value(data[:, 1]), value(data[:, 2]), np.full(len(data), uniform)])
    for b in np.unique(data[:, 0]):
        mine = data[:, 0] == b
        p, n = estimates[mine], data[mine, 3].astype(float)
        weight = out[b]
        for _ in range(rounds):
            share = p * weight
            share /= share.sum(1, keepdims=True)
            weight = n @ share / n.sum()
        # Nothing seen must stay possible.
        out[b] = (weight * n.sum() + [0, 0, 0.5]) / (n.sum() + 0.5)
    return out


@dataclass
class Trained:
    chunks: DataFrame
    answers: DataFrame
    blocks: int
    tokens: int
    words: int
    texts: int
    weights: np.ndarray


def chunk_shares(sizes: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], int]:
    """``(partition, first chunk, chunks)`` and the number of chunks: a large partition has several to itself, small ones share one."""
    shares, count, room = [], 0, 0
    for part, size in sorted(sizes):
        n = -(-size // CHUNK)
        if n > 1:
            shares.append((part, count, n))
            count, room = count + n, 0
            continue
        if size > room:
            count, room = count + 1, CHUNK
        shares.append((part, count - 1, 1))
        room -= size
    return shares, max(1, count)


def train(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> Trained:
    """Counts of the rows that are not ``held_out`` (a column), and the weights learned on them.

    ``docs`` is dealt to chunks in a bucketed table, which later steps read in place.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    parts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(F.octet_length("text") + 1), F.sum((~F.col("held_out")).cast("long"))).collect()
    size, texts = sum(p[1] for p in parts), sum(p[2] for p in parts)
    blocks = int(max(1, size // 8 // BLOCK))
    # Texts stay in the partition they are read in. Should one of them be cut otherwise when it is read again, its rows go to any chunk.
    shares, count = chunk_shares([(p[0], p[1]) for p in parts])
    place = rows.sparkSession.createDataFrame(shares, "_part int, _first int, _n int")
    number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = rows.withColumns({"_part": F.spark_partition_id(), "_number": number})
    chunk = F.coalesce(F.col("_first") + F.col("_number") % F.col("_n"), F.pmod(F.xxhash64("_part", "_number"), F.lit(count)))
    dealt = numbered.join(F.broadcast(place), "_part", "left").select("doc_id", "text", "held_out", chunk.cast("int").alias("chunk"))
    # A task reads whole buckets, so their number follows the chunks and not the session's partitions.
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // CHUNKS_PER_TASK))
    buckets = min(buckets, MOST_BUCKETS)
    chunks = materialize_bucketed(dealt, "texts", "chunk", buckets, in_place=True)
    answers = _questions(chunks, blocks).groupBy("block").applyInArrow(_answer_packed, "chunk int, block int, totals binary, different long, seen long")
    # In buckets like the texts: both steps that bring them together read them in place.
    answers = materialize_bucketed(answers, "counts", "chunk", buckets)
    stats = answers.where((F.col("chunk") == -1) & (F.col("block") < blocks)).agg(F.sum("seen"), F.sum("different")).first()
    out = Trained(chunks, answers.where("chunk >= 0"), blocks, stats[0] or 0, stats[1] or 0, texts, np.empty(0))
    tokens, train_texts = out.tokens, out.texts

    def cells(table: pa.Table, replies: pa.Table) -> pa.Table:
        empty = pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not table.num_rows:
            return empty
        c = Counts.of(table, replies, blocks, train_texts)
        word, pair, context = c.without_own()
        mine = (~table["held_out"].to_numpy())[c.tokens.text]
        p2 = np.where(context > 0, pair / np.maximum(context, 1), 0)
        p1 = word / max(tokens, 1)
        cell = (_bucket(context) * (STEPS + 1) + _steps(p2)) * (STEPS + 1) + _steps(p1)
        value, n = np.unique(cell[mine], return_counts=True)
        return pa.table({"cell": value, "n": n})

    grouped = chunks.groupBy("chunk").cogroup(out.answers.select("chunk", "block", "totals").groupBy("chunk"))
    found = grouped.applyInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    rows_ = [(c // (STEPS + 1) ** 2, c // (STEPS + 1) % (STEPS + 1), c % (STEPS + 1), n) for c, n in found]
    out.weights = learn_weights(rows_, 1 / (out.words + 1))
    return out


def score(model: Trained) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row the model was given."""
    blocks, tokens, words, texts, weights = model.blocks, model.tokens, model.words, model.texts, model.weights
    kind = model.chunks.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], table.schema.field("doc_id").type if n == "doc_id" else t) for n, t in zip(names, types, strict=True)})
        c = Counts.of(table, replies, blocks, texts)
        n = table.num_rows
        weight = weights[_bucket(c.context)]
        p = weight[:, 0] * np.where(c.context > 0, c.pair / np.maximum(c.context, 1), 0) + weight[:, 1] * (c.word / max(tokens, 1)) + weight[:, 2] / (words + 1)
        base = np.log10((c.word + 1) / (tokens + words + 1))
        sums = lambda x: np.bincount(c.tokens.text, x, n)
        return pa.table({
            "doc_id": table["doc_id"],
            "held_out": table["held_out"],
            "n_tokens": pa.array(c.tokens.size, pa.int64()),
            "n_known": pa.array(sums(c.word > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, tokens, np.int64)),
            "base_score": pa.array(sums(base)),
            "score": pa.array(sums(np.log10(p))),
        })

    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    grouped = model.chunks.groupBy("chunk").cogroup(model.answers.select("chunk", "block", "totals").groupBy("chunk"))
    return grouped.applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_by_fold(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Scores of all rows by a model of those outside fold ``held``; a NULL id is not held out.

    NULL and empty texts consist of the end token. Repeated rows count as often as they stand and
    come out alike. Other columns are not read. An empty table gives an empty result.
    """
    return score(train(docs.select("doc_id", "text"), fold(F.col("doc_id"), folds) == held))
