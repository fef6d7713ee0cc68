"""Removes passages of 35 words that stand in more than one place, by full-text indexes over shards.

Windows are dealt to shards by content: the smallest hash of eight words inside a window is its
anchor, and windows in a row with one anchor make a segment. Equal windows have equal anchors, so
an anchor that stands only once, in all the texts, takes all of its windows out. What is left is
collapsed to different segments. Each shard indexes its segments (see :mod:`fm_index`) and streams them
through the index by backward search, which gives the stretch of repeated windows of each
segment. A segment that stands in several places as a whole is repeated as it is.

An anchor with more than ``HOT_SEGMENTS`` different segments would make a shard too large; its
windows are counted one by one, as keys that are combined before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescout.llm.fm_index import FMIndex, repeated_stretches
from pagescout.llm.texts import Words, distinct_texts, mix, signed, text_chunks, text_key, words_of
from pagescout.operators.skew import lookup_join
from pagescout.storage import materialize

SPAN, GRAM = 35, 8
#: Words of a shard on average, and segments of one anchor that an index takes at most.
SHARD_WORDS, HOT_SEGMENTS = 400_000, 5_000


def segments(w: Words, span: int = SPAN, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Segments of texts: ``anchor, text, start`` (word in the text), ``windows``, and the hash of the content."""
    value, place = w.grams(gram)
    width = span - gram + 1
    size = value.size - width + 1
    if size <= 0:
        return {k: np.empty(0, t) for k, t in (("anchor", np.uint64), ("text", np.int64), ("start", np.int64), ("windows", np.int64), ("content", np.uint64))}
    value = mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    best, at = value[:size].copy(), place[:size].copy()
    for i in range(1, width):
        later = value[i : size + i]
        smaller = later <= best
        best, at = np.where(smaller, later, best), np.where(smaller, place[i : size + i], at)
    first = place[:size]
    whole = w.text[first] == w.text[place[width - 1 :]]
    best, at, first = best[whole], at[whole], first[whole]
    hashes, _ = w.grams(span)
    new = np.ones(first.size, bool)
    new[1:] = (at[1:] != at[:-1]) | (w.text[first[1:]] != w.text[first[:-1]])
    begin = np.flatnonzero(new)
    windows = np.diff(np.append(begin, first.size))
    inside = np.arange(first.size) - np.repeat(begin, windows)
    content = np.add.reduceat(mix(hashes + inside.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin) if begin.size else np.empty(0, np.uint64)
    text = w.text[first[begin]]
    return {"anchor": best[begin], "text": text, "start": first[begin] - w.first[text], "windows": windows, "content": mix(content + windows.astype(np.uint64))}


def _all_segments(docs: DataFrame) -> DataFrame:
    """``anchor, content, key, start, windows`` of all rows of ``docs`` (``key, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            s = segments(words_of(texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(s["anchor"])), pa.array(signed(s["content"])), part.column(0).take(pa.array(s["text"])), pa.array(s["start"], pa.int32()), pa.array(s["windows"], pa.int32())],
                names=["anchor", "content", "key", "start", "windows"],
            )

    return docs.select("key", "text").mapInArrow(run, "anchor long, content long, key binary, start int, windows int")


def _contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``anchor, content, weight, key, start, windows``) with ``words``, the hashes of the words of each segment."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "content", "weight", "start", "windows")).alias("these"))
    rows = distinct_texts(docs.select("key", "text"), "key").select("key", "text").join(lists, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            w = words_of(texts)
            for i, these in enumerate(part.column(2).to_pylist()):
                mine = w.hash[w.first[i] : w.first[i + 1]]
                words = [mine[s["start"] : s["start"] + s["windows"] + SPAN - 1].tobytes() for s in these]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([s[c] for s in these], t) for c, t in (("anchor", pa.int64()), ("content", pa.int64()), ("weight", pa.int64()), ("windows", pa.int32()))), pa.array(words, pa.binary())],
                    names=["anchor", "content", "weight", "windows", "words"],
                )

    return rows.mapInArrow(run, "anchor long, content long, weight long, windows int, words binary")


def _search_shard(table: pa.Table) -> pa.Table:
    """``anchor, content, low, high``: first and last repeated window of the segments of one shard."""
    words = [np.frombuffer(b, np.uint64) for b in table["words"].to_pylist()]
    sizes = np.array([x.size for x in words])
    _, symbols = np.unique(np.concatenate(words), return_inverse=True)
    # Symbol 0 stands between segments, so no match runs across.
    start = np.cumsum(sizes + 1) - sizes
    text = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
    text[np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(symbols.size)] = symbols + 1
    windows = table["windows"].to_numpy()
    low, high = repeated_stretches(FMIndex(text), text, start, windows, SPAN)
    # A segment that stands in more than one place repeats from end to end.
    several = table["weight"].to_numpy() > 1
    low, high = np.where(several, 0, low), np.where(several, windows - 1, high)
    found = pa.table({"anchor": table["anchor"], "content": table["content"], "low": pa.array(low, pa.int32()), "high": pa.array(high, pa.int32())})
    return found.filter(pa.array(low >= 0))


def _count_windows(rows: DataFrame) -> DataFrame:
    """The same result for segments of hot anchors, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in enumerate(batch.column(4).to_pylist()):
                words = np.frombuffer(b, np.uint64)
                views = np.lib.stride_tricks.sliding_window_view(words, SPAN)
                keys = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in views]
                one = [batch.column(c)[i].as_py() for c in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x] * len(keys), pa.int64()) for x in one), pa.array(range(len(keys)), pa.int32()), pa.array(keys, pa.binary())],
                    names=["anchor", "content", "weight", "place", "window"],
                )

    all_ = rows.mapInArrow(run, "anchor long, content long, weight long, place int, window binary")
    twice = all_.groupBy("window").agg(F.sum("weight").alias("n")).where("n > 1").select("window")
    return all_.join(twice, "window", "left_semi").groupBy("anchor", "content").agg(F.min("place").alias("low"), F.max("place").alias("high"))


def repeated_passages(docs: DataFrame, hot: int = HOT_SEGMENTS) -> DataFrame:
    """``key, spans``: for each text of ``docs`` (``key, text``; a row is an occurrence), the word ranges that repeated windows cover.

    Copies in ``docs`` are occurrences. Ranges are ``[from, to)``, in order and apart from one another.
    """
    found = _all_segments(docs)
    anchors = found.groupBy("anchor").count().where("count > 1").select("anchor")
    shared = materialize(
        found.join(anchors, "anchor", "left_semi").groupBy("anchor", "content", "key", "start", "windows").agg(F.count("*").alias("n")), "segments"
    )
    different = materialize(
        shared.groupBy("anchor", "content").agg(F.sum("n").alias("weight"), F.min(F.struct("key", "start", "windows")).alias("at")).select("anchor", "content", "weight", "at.*"),
        "different-segments",
    )
    wide = different.groupBy("anchor").agg(F.count("*").alias("_n")).where(F.col("_n") > hot).withColumn("_hot", F.lit(True)).select("anchor", "_hot")
    contents = materialize(_contents(docs, different), "segment-words")
    marked = contents.join(wide, "anchor", "left")
    words = different.agg(F.coalesce(F.sum(F.col("windows") + SPAN - 1), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-words // SHARD_WORDS)))).alias("shard")
    columns = ["anchor", "content", "weight", "windows", "words"]
    searched = (
        marked.where("_hot is null").select(shard, *columns).groupBy("shard").applyInArrow(_search_shard, "anchor long, content long, low int, high int")
    )
    counted = _count_windows(marked.where("_hot").select(*columns))
    stretches = materialize(searched.unionByName(counted), "stretches")
    start = F.col("start") + F.col("low")
    return (
        shared.join(stretches, ["anchor", "content"])
        .groupBy("key")
        .agg(F.collect_list(F.struct(start.alias("from"), (F.col("start") + F.col("high") + SPAN).alias("to"))).alias("spans"))
        .select("key", _joined(F.array_sort("spans")).alias("spans"))
    )


def _joined(spans: Column) -> Column:
    """Ranges in order of their start, with those that meet made one."""

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["from"].alias("from"), F.greatest(last["to"], s["to"]).alias("to"))
        return F.when(s["from"] <= last["to"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.slice(spans, F.lit(1), F.lit(1)), add)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_words`` for every row of ``docs``.

    A word goes if a window of 35 words covers it whose sequence also starts elsewhere, in the same
    or another row. ``kept_words`` are the other words, joined by one space. Repeated rows are
    places of their own. NULL and empty texts have no words. With ``keep`` all columns of ``docs``
    come too; the added ones replace those of the same names.
    """
    added = ["n_words", "n_removed", "kept_words"]
    kept = [c for c in docs.columns if c not in added] if keep else [id_col]
    key = text_key(F.col(text_col))
    texts = docs.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = materialize(repeated_passages(texts), "spans").select(F.col("key").alias("_key"), F.col("spans").alias("_spans"))
    # The row goes along as one column, so that no name of its own meets another.
    rows = docs.select(F.struct(*kept).alias("row"), key.alias("_key"), F.col(text_col).cast("string").alias("_text"))
    joined = lookup_join(rows, spans, "_key").select("row", "_spans", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts_ in text_chunks(batches, "_text"):
            n_words, n_removed, left = [], [], []
            for text, ranges in zip(texts_, part.column(1).to_pylist(), strict=True):
                words = (text or b"").split()
                gone = np.zeros(len(words), bool)
                for r in ranges or ():
                    gone[r["from"] : r["to"]] = True
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                left.append(b" ".join(x for x, out in zip(words, gone.tolist(), strict=True) if not out).decode() if n_removed[-1] else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(left, pa.string())], names=["row", *added]
            )

    schema = T.StructType([joined.schema["row"], *T.StructType.fromDDL("n_words long, n_removed long, kept_words string").fields])
    return joined.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c if keep else "doc_id") for c in kept], *added)
