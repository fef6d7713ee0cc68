"""Benchmark decontamination by winnowing.

Of all runs of 5 words in a window of 10, the one with the smallest hash (the last of equal ones)
is the fingerprint of the window. Equal windows choose the same fingerprint at the same place, so
every window shared with an item passes a filter of the items' fingerprints. Windows that pass are
joined on the hash of the whole window and compared word by word. An item of fewer than 10 words is one
window of its own length, and is its own fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagescout.llm.texts import ALNUM, Words, mix, signed, text_chunks, text_key, words_of
from pagescout.operators.skew import lookup_join
from pagescout.storage import materialize

SPAN, GRAM = 10, 5
#: Bits of the filter of benchmark fingerprints: 32 a fingerprint within these bounds (8 MB at most).
FILTER_BITS = (1 << 22, 1 << 26)
_SLICE_BITS = 1 << 16


def winnow(w: Words, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and first word of every window of ``span`` words."""
    value, place = w.grams(gram)
    width = span - gram + 1
    if value.size < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    best = value[: value.size - width + 1].copy()
    for i in range(1, width):
        later = value[i : value.size - width + 1 + i]
        best = np.where(later <= best, later, best)
    # The last run of a window must be in the text of the first.
    start, end = place[: best.size], place[width - 1 :]
    whole = w.text[start] == w.text[end]
    return best[whole], start[whole]


def spans(w: Words, lengths: list[int]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: fingerprint, window hash, first word of all windows of that length."""
    out = []
    for n in lengths:
        whole, start = w.grams(n)
        print_ = winnow(w)[0] if n == SPAN else mix(whole + np.uint64(n))
        out.append((n, print_, whole, start))
    return out


_SPAN_TYPE = pa.struct([("print", pa.int64()), ("whole", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("words", pa.string())])
_SPAN_DDL = "array<struct<print: long, whole: long, start: int, size: int, words: string>>"


def _words(w: Words, start: int, n: int) -> str:
    return b" ".join(w.data[a:b].tobytes() for a, b in zip(w.start[start : start + n], w.end[start : start + n], strict=True)).decode()


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``whole, print, words, size, items``: every different window with the ids of its items.

    Items without words have no windows. Items that share an id are one item. The windows of items without id are
    windows like others, but no item's.
    """
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            w = words_of(texts, ALNUM, lower=True)
            found = [[] for _ in texts]
            count = np.diff(w.first)
            for n, print_, whole, start in spans(w, sorted({min(int(c), SPAN) for c in count if c})):
                for p, h, s in zip(signed(print_).tolist(), signed(whole).tolist(), start.tolist(), strict=True):
                    t = int(w.text[s])
                    if min(count[t], SPAN) == n:
                        found[t].append({"print": p, "whole": h, "start": s - int(w.first[t]), "size": n, "words": _words(w, s, n)})
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(_SPAN_TYPE))], names=["item_id", "spans"])

    kind = rows.schema["item_id"].dataType.simpleString()
    return (
        rows.mapInArrow(run, f"item_id {kind}, spans {_SPAN_DDL}")
        .select("item_id", F.inline("spans"))
        .groupBy("whole", "print", "words", "size")
        .agg(F.collect_set("item_id").alias("items"))
    )


def print_filter(prints: DataFrame, size: tuple[int, int] = FILTER_BITS, each: int = 32) -> np.ndarray:
    """Bits of a filter that lets every fingerprint of ``prints`` pass, in size between two bounds, whatever their number is."""
    low, high = size
    bits = min(max(low, 1 << (each * prints.count()).bit_length()), high)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(_SLICE_BITS, np.uint8)
        flags[rows["bit"].to_numpy()] = 1
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "flags": [np.packbits(flags).tobytes()]})

    place = F.explode(F.array(F.col("print").bitwiseAND(bits - 1), F.shiftrightunsigned("print", 32).bitwiseAND(bits - 1)))
    slices = (
        prints.select(place.alias("place"))
        .select((F.col("place") / _SLICE_BITS).cast("long").alias("slice"), (F.col("place") % _SLICE_BITS).alias("bit"))
        .distinct()
        .groupBy("slice")
        .applyInPandas(pack, "slice long, flags binary")
    )
    out = np.zeros(bits // 8, np.uint8)
    for row in slices.collect():
        out[row["slice"] * _SLICE_BITS // 8 :][: _SLICE_BITS // 8] = np.frombuffer(row["flags"], np.uint8)
    return out


def passes(flags: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which fingerprints the filter lets pass."""
    low = np.uint64(flags.size * 8 - 1)
    yes = np.ones(prints.size, bool)
    for place in (prints & low, (prints >> np.uint64(32)) & low):
        yes &= (flags[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1 == 1
    return yes


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``doc_id, n_words, n_hit, items, n_items, contaminated`` for every row of ``docs``.

    With ``keep`` all columns of ``docs`` come too (added ones replace those of the same name).
    ``items`` are the ids of the items that have a window in the text. NULL and empty texts have
    no words. Copies of a text are looked up once. An empty benchmark contaminates nothing.
    """
    added = ["n_words", "n_hit", "items", "n_items", "contaminated"]
    kept = [c for c in docs.columns if c not in added] if keep else [id_col]
    items = materialize(item_windows(benchmark), "item-windows")
    lengths = sorted(r[0] for r in items.select("size").distinct().collect())  # ten at most
    flags = docs.sparkSession.sparkContext.broadcast(print_filter(items.select("print").distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = flags.value
        for part, texts in text_chunks(batches, "_text"):
            w = words_of(texts, ALNUM, lower=True)
            found = [[] for _ in texts]
            for n, print_, whole, start in spans(w, lengths):
                hit = np.flatnonzero(passes(bits, print_))
                for p, h, s in zip(signed(print_[hit]).tolist(), signed(whole[hit]).tolist(), start[hit].tolist(), strict=True):
                    t = int(w.text[s])
                    found[t].append({"print": p, "whole": h, "start": s - int(w.first[t]), "size": n, "words": _words(w, s, n)})
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(w.first), pa.int64()), pa.array(found, pa.list_(_SPAN_TYPE))],
                names=["row", "_key", "_n_words", "_spans"],
            )

    # The row goes along as one column, so that no name of its own meets another.
    rows = docs.select(F.struct(*kept).alias("row"), text_key(F.col(text_col)).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL(f"_n_words long, _spans {_SPAN_DDL}").fields])
    base = materialize(rows.mapInArrow(run, schema), "windows")
    suspect = F.size("_spans") > 0
    spans_of = base.where(suspect).groupBy("_key").agg(F.first("_spans").alias("_spans")).select("_key", F.inline("_spans"))
    lookup = items.select("whole", F.col("print").alias("_print"), F.col("words").alias("_words"), "items")
    hits = lookup_join(spans_of, lookup, "whole").where((F.col("print") == F.col("_print")) & (F.col("words") == F.col("_words")))
    per_text = hits.groupBy("_key").agg(
        F.collect_set(F.struct("start", "size")).alias("_starts"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("_items")
    )
    words_hit = F.size(F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))))
    no_items = F.col("_items").isNull()
    found = base.where(suspect).drop("_spans").join(per_text, "_key", "left")
    clean = base.where(~suspect).drop("_spans").withColumns(
        {"_starts": F.lit(None).cast(per_text.schema["_starts"].dataType), "_items": F.lit(None).cast(per_text.schema["_items"].dataType)}
    )
    return found.unionByName(clean).select(
        *[F.col("row")[c].alias(c if keep else "doc_id") for c in kept],
        F.col("_n_words").alias("n_words"),
        F.when(no_items, 0).otherwise(words_hit).cast("long").alias("n_hit"),
        F.coalesce("_items", F.array().cast(per_text.schema["_items"].dataType)).alias("items"),
        F.when(no_items, 0).otherwise(F.size("_items")).cast("long").alias("n_items"),
        (~no_items).alias("contaminated"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of :func:`contamination`."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")
