"""Near duplicates by an n-gram Jaccard join with prefix filtering.

The set of a text is its distinct shingles of five words, ordered rare first. Two sets that are
similar enough share a shingle among their first ones, so only those prefixes are joined. A pair
must also be near in length, have enough left behind the shared shingle (positional filter), and
differ little enough in what is left (suffix filter, by the parity of 64 classes of shingles).
What passes is verified once, on whole texts.

Links are wanted as components. A shared shingle first compares all its texts with one of
them, a hub. As long as the lists of texts that are still in different components would make more pairs
than a further turn does, and the last turn has found links, they get other hubs, eight times as many
each turn. In the end the texts of one list that are still in different components are paired.
So a group of thousands of near copies costs a few comparisons a text, also if none of them is
near to all others, and still no link between components is lost.

Rarity comes from counts in a table of fixed size over all shingles of all texts: any fixed order
gives the same links, the counts only make prefixes rare.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescout.llm.components import components
from pagescout.llm.texts import SPACED, signed, text_chunks, text_key, words_of
from pagescout.operators.skew import fits_broadcast
from pagescout.storage import materialize

SHINGLE = 5
#: Cells of the table of counts: 4 MB. More cells keep rarity sharp on more text.
CELLS = 1 << 20
_SLICE = 1 << 16
#: Hubs that an open list gets in the second turn; each further turn has so many times as many.
HUBS = 8
#: Pairs of one text that are verified in one task; the text of a hub goes to as many as it needs.
PAIRS_A_TASK = 256


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct shingles of texts, sorted by both.

    A text of fewer words than a shingle has its whole sequence as its only one.
    """
    w = words_of(texts, SPACED, lower=True)
    count = np.diff(w.first)
    found = []
    for n in range(1, SHINGLE + 1):
        if n < SHINGLE and not (count == n).any():
            continue
        value, place = w.grams(n)
        text = w.text[place]
        mine = (count[text] == n) if n < SHINGLE else slice(None)
        found.append((text[mine], value[mine]))
    text = np.concatenate([t for t, _ in found]) if found else np.empty(0, np.int64)
    value = np.concatenate([v for _, v in found]) if found else np.empty(0, np.uint64)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(text.size, bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def _cell(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def rarity(docs: DataFrame) -> np.ndarray:
    """How many shingles of all texts fall into each cell; each task sends its cells once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for _, texts in text_chunks(batches):
            cells += np.bincount(_cell(shingles(texts)[1]), minlength=CELLS)
        if cells.any():
            slices = cells.astype(np.uint32).reshape(-1, _SLICE)
            packed = [zlib.compress(s.tobytes(), 1) for s in slices]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(packed)), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "cells"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_SLICE, np.int64)
        for cells in rows["cells"]:
            total += np.frombuffer(zlib.decompress(cells), np.uint32)
        packed = zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "cells": [packed]})

    slices = docs.select("text").mapInArrow(count, "slice int, cells binary").groupBy("slice").applyInPandas(add, "slice int, cells binary")
    out = np.zeros(CELLS, np.uint32)
    for row in slices.collect():
        out[row["slice"] * _SLICE :][:_SLICE] = np.frombuffer(zlib.decompress(row["cells"]), np.uint32)
    return out


def prefixes(docs: DataFrame, counts, tenths: int) -> DataFrame:
    """``shingle, id, n, place, rest``: the prefix of every text of ``docs`` (``id, text``).

    ``place`` is the rank of the shingle in its text, ``rest`` the parities of the shingles behind it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for part, texts in text_chunks(batches):
            text, value = shingles(texts)
            order = np.lexsort((value, often[_cell(value)], text))
            text, value = text[order], value[order]
            n = np.bincount(text, minlength=len(texts))
            start = np.cumsum(n) - n
            place = np.arange(text.size) - start[text]
            # Exclusive-or sums from the front; between two of them lie the parities of a stretch.
            bits = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(np.uint64(1) << (value & np.uint64(63)))]) if value.size else np.zeros(1, np.uint64)
            least = -(-n * tenths // 10)
            mine = np.flatnonzero(place < (n - least + 1)[text])
            rest = bits[(start + n)[text[mine]]] ^ bits[mine + 1]
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(value[mine])), pa.array(ids[text[mine]]), pa.array(n[text[mine]], pa.int32()), pa.array(place[mine], pa.int32()), pa.array(signed(rest))],
                names=["shingle", "id", "n", "place", "rest"],
            )

    return docs.select("id", "text").mapInArrow(run, "shingle long, id long, n int, place int, rest long")


def _may_link(a: str, b: str, tenths: int) -> Column:
    """Length, positional and suffix filters on two entries of one shingle."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    # Overlap that the similarity asks for: tenths / (10 + tenths) of both sizes together.
    need = F.floor((tenths * (na + nb) + 9 + tenths) / (10 + tenths))
    behind_a, behind_b = na - F.col(f"{a}.place") - 1, nb - F.col(f"{b}.place") - 1
    apart = F.bit_count(F.col(f"{a}.rest").bitwiseXOR(F.col(f"{b}.rest")))
    return (
        (10 * F.least(na, nb) >= tenths * F.greatest(na, nb))
        & (1 + F.least(behind_a, behind_b) >= need)
        & (apart <= behind_a + behind_b - 2 * (need - 1))
    )


def _verified(pairs: DataFrame, docs: DataFrame, tenths: int) -> DataFrame:
    """``a, b, id_a, id_b``: keys and ids of pairs (``a, b`` by id) whose whole sets are similar enough."""
    members = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "members")
    wanted = F.broadcast(members) if fits_broadcast(members) else members
    texts = (
        docs.join(wanted, "id", "left_semi")
        .groupBy("id")
        .agg(F.collect_set(F.struct("key", "text")).alias("texts"))
        .select("id", F.inline("texts"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                n = part.num_rows
                both = [t for c in (2, 3) for t in part.column(c).cast(pa.binary()).to_pylist()]
                text, value = shingles(both)
                edge = np.searchsorted(text, np.arange(2 * n + 1))
                sets = [value[edge[i] : edge[i + 1]] for i in range(2 * n)]
                same = [np.intersect1d(sets[i], sets[n + i], assume_unique=True).size for i in range(n)]
                linked = [10 * s >= tenths * (sets[i].size + sets[n + i].size - s) > 0 for i, s in enumerate(same)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in (0, 1, 4, 5)], names=["a", "b", "id_a", "id_b"]).filter(pa.array(linked, pa.bool_()))

    a = texts.select(F.col("id").alias("a"), F.col("key").alias("key_a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("key").alias("key_b"), F.col("text").alias("text_b"))
    hot = pairs.groupBy("a").count().where(F.col("count") > PAIRS_A_TASK).select("a", F.ceil(F.col("count") / PAIRS_A_TASK).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    hot = F.broadcast(hot) if fits_broadcast(hot) else hot
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    a = a.join(hot, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    rows = dealt.join(b, "b").join(a, ["a", "part"]).select("key_a", "key_b", "text_a", "text_b", F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    return rows.mapInArrow(compare, "a binary, b binary, id_a long, id_b long")


def link_texts(docs: DataFrame, tenths: int = 8) -> DataFrame:
    """``node, label``: texts (by key) that are linked with another text, and their component.

    ``docs`` has ``key, id, text``; ``id`` is 64 bits of the key. Texts of equal id are told apart by key
    when pairs are verified.
    """
    counts = docs.sparkSession.sparkContext.broadcast(rarity(docs))
    entries = prefixes(docs, counts, tenths)
    shared = entries.groupBy("shingle").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a != _b").select("shingle")
    # Copies of a text have the same entries; one of each stays.
    lists = materialize(entries.join(shared, "shingle", "left_semi").distinct(), "prefixes")
    alone = F.unhex(F.lpad(F.hex("id"), 16, "0"))
    entry = F.struct("id", "n", "place", "rest", "label")
    open_, labels, compared, nodes, turn = lists.withColumn("label", alone), None, None, None, 0
    while True:
        # The first hub is the same in all lists of a group, so most texts meet one other; later ones differ from list to list.
        order = F.xxhash64("shingle", "id", F.lit(turn)) if turn else F.col("id")
        hubs = open_.groupBy("shingle", F.pmod(F.xxhash64("id"), F.lit(HUBS**turn)).alias("_hub")).agg(F.min_by(entry, order).alias("b")).drop("_hub")
        star = materialize(_candidates(open_.select("shingle", entry.alias("a")), hubs, compared, tenths), "star-pairs")
        compared = star if compared is None else compared.union(star)
        links = materialize(_verified(star, docs, tenths), "star-links")
        nothing = links.isEmpty()
        if labels is None or not nothing:
            labels = components(_with_links(labels, links))
            found = links.select(F.col("a").alias("node"), F.col("id_a").alias("id")).union(links.select("b", "id_b"))
            nodes = found if nodes is None else nodes.union(found)
            by_id = nodes.join(labels, "node").groupBy("id").agg(F.min("label").alias("label"))
            placed = open_.drop("label").join(by_id, "id", "left").withColumn("label", F.coalesce("label", alone))
            mixed = placed.groupBy("shingle").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a != _b").select("shingle")
            open_ = materialize(placed.join(mixed, "shingle", "left_semi"), "open-lists")
        sizes = open_.groupBy("shingle", "label").agg(F.count("*").alias("m"))
        largest = materialize(sizes.groupBy("shingle").agg(F.sum("m").alias("m"), F.max(F.struct("m", "label")).alias("top")).select("shingle", "m", F.col("top.m").alias("n"), F.col("top.label").alias("top")), "largest")
        rows, pairs = largest.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.col("m") * (F.col("m") - F.col("n")).cast("double")), F.lit(0.0))).first()
        if nothing or pairs <= HUBS ** (turn + 1) * rows:
            break
        turn += 1
    # Texts outside the largest component of a list that is still open meet all others in it.
    few = open_.join(largest.select("shingle", "top"), "shingle").where("label != top").select("shingle", entry.alias("a"))
    cross = _candidates(few, open_.select("shingle", entry.alias("b")), compared, tenths)
    more = materialize(_verified(materialize(cross, "cross-pairs"), docs, tenths), "cross-links")
    return labels if more.isEmpty() else components(_with_links(labels, more))


def _candidates(left: DataFrame, right: DataFrame, compared: DataFrame | None, tenths: int) -> DataFrame:
    """``a, b``: ids, the smaller one first, of entries of one shingle in different components that pass the filters and have not been compared."""
    found = (
        left.join(right, "shingle")
        .where((F.col("a.label") != F.col("b.label")) & _may_link("a", "b", tenths))
        .select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
        .distinct()
    )
    return found if compared is None else found.join(compared, ["a", "b"], "left_anti")


def _with_links(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """New links together with what earlier ones joined, as a star around each label."""
    new = links.select("a", "b")
    return new if labels is None else labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a != b").union(new)


def near_duplicates(docs: DataFrame, tenths: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, key`` per row of ``docs``.

    Texts link when the Jaccard similarity of their shingle sets is ``tenths / 10`` or more; equal
    texts always do. ``component_id`` is the smallest ``doc_id`` reachable by links, NULL ids aside.
    A text without words (NULL, empty) links with nothing and is its own component, copies
    included. Rows are documents: repeated rows are copies of each other; ``key`` stands
    for the text. Other columns are not read.
    """
    key = text_key(F.col(text_col))
    # The id is the first half of the key.
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    half = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    texts = rows.select("key", half.alias("id"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, these in text_chunks(batches):
            n = np.bincount(shingles(these)[0], minlength=len(these))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc_id", "key", "n_shingles"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    sized = materialize(rows.mapInArrow(count, f"doc_id {kind}, key binary, n_shingles long"), "sized")
    labels = link_texts(texts, tenths)
    # One row per text, so that thousands of copies do not meet in a join.
    per_text = sized.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    label = F.coalesce("label", "key")
    grouped = per_text.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", label)
    grouped = materialize(grouped, "grouped")
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    found = grouped.join(least, "label").select("key", "component_id")
    return (
        sized.join(found, "key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "key")
    )
