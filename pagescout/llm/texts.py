"""What the text operators share: words as columns, words as hashed arrays, distinct texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text handled at one time inside a task, in bytes; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Words hashed at one time.
_SLICE = 1 << 15

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words that white space (0x20, 0x09-0x0D) ends.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words that keep digits, lower-case ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def spaced_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """The words of several texts, one after the other: 64-bit hash, byte range, text number."""

    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # of each text: its first word; one more entry at the end

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words within one text, and the place of their first word."""
        size = self.hash.size - n + 1
        if size <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        total = np.zeros(size, np.uint64)
        for i in range(n):
            total += self.hash[i : i + size] * _STEP[i % 64] + np.uint64(i // 64)
        place = np.flatnonzero(self.text[:size] == self.text[n - 1 :])
        return mix(total[place]), place


def words_of(texts: list[bytes | None], kind: np.ndarray = SPACED, lower: bool = False) -> Words:
    """Words of texts in UTF-8. Equal words have equal hashes in every task and run."""
    texts = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    inside = kind[data]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 1
    first = np.concatenate([[0], np.searchsorted(start, np.cumsum(sizes))]).astype(np.int64)
    if start.size:
        length = end - start
        begin = np.cumsum(length) - length
        letters = data[inside]
        power = np.multiply.accumulate(np.full(int(length.max()), _BASE, np.uint64))
        value = np.empty(start.size, np.uint64)
        for a in range(0, start.size, _SLICE):
            part, size = begin[a : a + _SLICE] - begin[a], length[a : a + _SLICE]
            mine = letters[begin[a] : begin[a] + size.sum()]
            place = np.arange(mine.size) - np.repeat(part, size)
            value[a : a + _SLICE] = np.add.reduceat(_BYTE[mine] * power[place], part)
        value = mix(value + length.astype(np.uint64))
    else:
        value = np.empty(0, np.uint64)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, value, start, end, text, first)


def text_chunks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of Arrow batches of about ``CHUNK_BYTES`` of text, with the texts as bytes."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
        start = size = 0
        for i, one in enumerate(texts):
            size += len(one or b"") + 1
            if size >= CHUNK_BYTES or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def binary(values: list) -> pa.Array:
    """A binary column of bytes or numpy arrays."""
    return pa.array([v if v is None or isinstance(v, bytes) else v.tobytes() for v in values], pa.binary())


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return np.ascontiguousarray(values).view(np.int64)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; NULL counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every different text once: ``key, text, doc_id`` (the smallest), ``n`` (rows with it).

    Copies are merged in each task before they are shuffled, so a text that makes up a third
    of all rows costs one row per task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(text_key(F.col(text_col)).alias("key"), text.alias("text"), F.col(id_col).alias("doc_id"))
        .groupBy("key")
        .agg(F.first("text").alias("text"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    )


def fold(doc_id: Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 5) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents outside fold 0.

    The rows are those with the smallest hash of their id, so the choice repeats and does not
    follow any order of the input. The list of ids is bounded by ``rows`` and is broadcast. Of the
    rows that share an id, the one with the smallest :func:`text_key` stands; they are reduced in
    each task before they are shuffled. Rows without id, label or text row do not take part.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    one = found.groupBy("doc_id", "label").agg(F.min_by("text", text_key(F.col("text"))).alias("text"))
    return one.select("doc_id", "text", "label")
