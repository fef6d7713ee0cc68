"""Phrase collocations by Toivonen's mining: a sample proposes, full passes count exactly until closed.

The phrases that are common in a sample, at a lowered bound, are proposed. Their negative border are the
phrases whose parts of one word less are all proposed, but not they themselves (and all single words). One
pass over all texts counts proposals and border exactly. A phrase that turns out common although it
was not proposed has failed the border: it is proposed now, and one more pass counts what that adds to
the border. Without such a failure every common phrase has been counted. With phrases of n words
there are at most n passes.

Tasks know the proposals as a bit filter of bounded size. What it lets pass by mistake, or because it
is full, is counted too, exactly like the rest: the filter decides about work, never about results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescout.llm.decontaminate import passes, print_filter
from pagescout.llm.texts import Words, mix, signed, words_of
from pagescout.operators.skew import first_n_per_group, fits_broadcast, lookup_join
from pagescout.storage import materialize

#: A phrase is common with so many occurrences in its language.
LEAST = 10
#: Words of the longest phrases.
LONGEST = 3
#: One of so many documents is in the sample; a phrase is proposed with so many occurrences there.
SAMPLE, LEAST_IN_SAMPLE = 4, 2
#: Bits of a filter of proposals within these bounds (64 MB at most), and bits a phrase.
FILTER_BITS, BITS_EACH = (1 << 20, 1 << 29), 8

#: Text handled at one time inside a task, in bytes; one longer piece makes a chunk of its own.
CHUNK_BYTES = 1 << 19

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CUT = re.compile(rb"[.,;:!?\x0A-\x0D]")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes]]]:
    """Texts of one language, about ``CHUNK_BYTES`` at a time; longer texts are cut between pieces."""
    for batch in batches:
        by_lang: dict[bytes, list[int]] = {}
        for i, lang in enumerate(batch.column(0).cast(pa.binary()).to_pylist()):
            by_lang.setdefault(lang, []).append(i)
        texts = batch.column(1).cast(pa.binary())
        for lang, rows in by_lang.items():
            held, size = [], 0
            for i in rows:
                text, at = texts[i].as_py() or b"", 0
                while at < len(text):
                    cut = _CUT.search(text, at + CHUNK_BYTES) if len(text) - at > CHUNK_BYTES else None
                    end = cut.end() if cut else len(text)
                    held.append(text[at:end])
                    size, at = size + end - at, end
                    if size >= CHUNK_BYTES:
                        yield lang, held
                        held, size = [], 0
            if held:
                yield lang, held


def _lang_hash(lang: bytes) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(lang, digest_size=8).digest(), "little"))


def _hashes(w: Words, start: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Hashes of the phrases of 1, 2, ... n words that follow each other, ``start`` being the hash of no word."""
    now = mix(w.hash + start)
    yield now
    for k in range(1, n):
        now = mix(now[:-1] * _STEP + w.hash[k:])
        yield now


def _codes(code: np.ndarray, kinds: int, at: np.ndarray, n: int) -> np.ndarray:
    """Numbers that are equal for equal rows of n word numbers, and for no others."""
    out, bound = code[at], kinds
    for k in range(1, n):
        if bound * kinds >= 1 << 62:
            _, out = np.unique(out, return_inverse=True)
            bound = int(out.max(initial=0)) + 1
        out, bound = out * kinds + code[at + k], bound * kinds
    return out


def _count_chunk(lang: bytes, texts: list[bytes], longest: int, filters: list[list[np.ndarray]] | None) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
    """``(keys, words of a phrase, counts)`` for each length; without filters everything is counted."""
    w = words_of(texts, _WORD, lower=True)
    if not w.hash.size:
        return
    size = w.end - w.start
    letters = w.data[_WORD[w.data]]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), size.size, [None, pa.py_buffer(offsets), pa.py_buffer(letters.tobytes())])
    known_words = code = None
    breaks = np.cumsum(_BREAK[w.data])
    joined = breaks[w.start[1:]] == breaks[w.end[:-1] - 1]
    first = filters is None or len(filters) == 1
    whole = np.ones(size.size, bool)
    known: list[np.ndarray] = []
    for n, print_ in enumerate(_hashes(w, _lang_hash(lang), min(longest, size.size)), 1):
        if n > 1:
            whole = whole[:-1] & joined[n - 2 :]
        wanted = whole.copy()
        if filters is not None and n > 1:
            wanted &= known[-1][:-1] & known[-1][1:]
            for earlier in known[:-1]:
                wanted &= ~(earlier[:-1] & earlier[1:])
        if filters is not None and n < longest:
            # The last filter counts now; the ones before it have been counted.
            known = [whole & passes(f[n - 1], print_) for f in filters]
        if n == 1 and not first:
            continue
        at = np.flatnonzero(wanted)
        if not at.size:
            continue
        if 8 * at.size < size.size:  # too few to number all words for
            place, count = at, np.ones(at.size, np.int64)
            parts = [words.take(pa.array(place + k)) for k in range(n)]
        else:
            if code is None:
                numbered = words.dictionary_encode()
                known_words, code = numbered.dictionary, numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            _, where, count = np.unique(_codes(code, len(known_words), at, n), return_index=True, return_counts=True)
            place = at[where]
            parts = [known_words.take(pa.array(code[place + k])) for k in range(n)]
        key = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n > 1 else parts[0]
        key = pc.binary_join_element_wise(pa.scalar(lang, pa.large_binary()), key, pa.scalar(b"\n", pa.large_binary()))
        yield key.cast(pa.large_string()).cast(pa.string()), n, count
    if filters is not None and first:
        yield pa.array([lang.decode() + "\n"]), 0, np.array([size.size])


def _count(rows: DataFrame, longest: int, filters: list[Broadcast] | None = None) -> DataFrame:
    """``key, size, a``: phrases (language, line feed, words) with their occurrences; size 0 counts the words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = filters and [f.value for f in filters]
        for lang, texts in _chunks(batches):
            for key, n, count in _count_chunk(lang, texts, longest, flags):
                yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(key), n, np.int32)), pa.array(count, pa.int64())], names=["key", "size", "a"])

    return rows.mapInArrow(run, "key string, size int, a long").groupBy("key", "size").agg(F.sum("a").alias("a"))


def _prints(phrases: DataFrame, known: Broadcast | None = None) -> DataFrame:
    """``key, size, print``: the hash under which tasks meet a phrase; without those that the filters ``known`` let pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [k.encode().rsplit(b"\n", 1) for k in batch.column(0).to_pylist()]
            w = words_of([p for _, p in split], _WORD)
            now = mix(w.hash[w.first[:-1]] + np.array([_lang_hash(lang) for lang, _ in split], np.uint64))
            size = np.diff(w.first)
            for k in range(1, int(size.max(initial=0))):
                more = size > k
                now[more] = mix(now[more] * _STEP + w.hash[w.first[:-1][more] + k])
            new = np.ones(size.size, bool)
            for n, flags in enumerate(known.value if known else [], 1):
                new[size == n] = ~passes(flags, now[size == n])
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed(now))], names=["key", "size", "print"])
            yield out.filter(pa.array(new))

    return phrases.select("key", "size").mapInArrow(run, "key string, size int, print long")


def common_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``key, size, a``: every phrase of up to ``longest`` words with ``least`` occurrences or more in its language.

    ``key`` is the language, a line feed and the words joined by spaces; size 0 has the number of words of a
    language. NULL texts have no words, a NULL language is ``und``. Repeated rows count as often as they stand.
    """
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit("und"))
    in_sample = F.pmod(F.xxhash64(docs[id_col], docs[text_col]), F.lit(SAMPLE)) == 0
    columns = [lang.alias("lang"), docs[text_col].cast("string").alias("text")]
    rows = docs.where(docs[text_col].isNotNull()).select(*columns)
    proposed = materialize(_prints(_count(docs.where(in_sample & docs[text_col].isNotNull()).select(*columns), longest - 1).where(F.col("a") >= LEAST_IN_SAMPLE)), "proposals")
    found, filters = None, []
    for n_pass in range(longest):
        flags = [print_filter(proposed.where(F.col("size") == n).select("print"), FILTER_BITS, BITS_EACH) for n in range(1, longest)]
        filters.append(docs.sparkSession.sparkContext.broadcast(flags))
        counted = _count(rows, longest, list(filters)).where((F.col("a") >= least) | (F.col("size") == 0))
        new = materialize(counted, f"phrases-{n_pass}")
        found = new if found is None else found.unionByName(new)
        failed = materialize(_prints(new.where(F.col("size").between(1, longest - 1)), filters[-1]), "failures")
        if failed.isEmpty():
            break
        proposed = proposed.unionByName(failed)
    return found


def _phrase(key: Column) -> Column:
    return F.substring_index(key, "\n", -1)


def _lang(key: Column) -> Column:
    return F.substring(key, F.lit(1), F.length(key) - F.length(_phrase(key)) - 1)


def score() -> Column:
    """``floor(10^6 a^2 / (l r))``, exact; a long, as no phrase is more common than its parts."""
    return F.expr("(1000000BD * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")


def _outside(many: DataFrame, longest: int, share: int) -> DataFrame:
    """``key, size, a`` of the phrases that no longer one holds with ``share`` percent of their occurrences.

    Phrases and what longer ones hold are grouped together, each once: no join, whose rows would move again.
    """
    words, prefix = F.split(_phrase(F.col("key")), " "), F.concat(_lang(F.col("key")), F.lit("\n"))
    split = many.where("size >= 3").withColumns({"_words": words, "_prefix": prefix})
    none = lambda kind: F.lit(None).cast(kind)
    rows = [many.select("key", "size", "a", none("long").alias("longer"))]
    for n in range(2, longest):
        for i in range(1, longest - n + 2):
            inner = F.concat("_prefix", F.array_join(F.slice("_words", i, n), " "))
            rows.append(split.where(F.col("size") >= max(n + 1, n + i - 1)).select(inner.alias("key"), none("int").alias("size"), none("long").alias("a"), F.col("a").alias("longer")))
    grouped = reduce(DataFrame.unionByName, rows).groupBy("key").agg(F.max("size").alias("size"), F.max("a").alias("a"), F.max("longer").alias("longer"))
    return grouped.where(F.col("a").isNotNull() & F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).select("key", "size", "a")


def collocations(docs: DataFrame, top: int = 2000, share: int = 50, **options) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of two words or more, from the best one on.

    ``a`` counts the phrase; ``l`` and ``r`` its two parts at the cut with the lowest ``score = floor(10^6 a^2 / (l r))`` (of
    equal ones the first cut); ``n`` the words of the language. A phrase goes if a common longer one holds it and has
    ``share`` percent of its occurrences or more. ``top`` bounds the rows of a language. Options and the treatment of NULL and repeated rows: :func:`common_phrases`.
    An empty table gives an empty result.
    """
    common, longest = common_phrases(docs, **options), options.get("longest", LONGEST)
    many = _outside(common.where("size >= 2"), longest, share)
    words, prefix = F.split(_phrase(F.col("key")), " "), F.concat(_lang(F.col("key")), F.lit("\n"))
    # Written once, as both lookups count the parts before they join.
    many = materialize(many, "uncut").withColumns({"_words": words, "_prefix": prefix})
    span = lambda first, n: F.concat("_prefix", F.array_join(F.slice("_words", first, n), " "))
    cut_at = [
        many.where(F.col("size") > k).select("a", F.lit(k).alias("k"), span(F.lit(1), F.lit(k)).alias("left"), span(F.lit(k + 1), F.col("size") - k).alias("right"))
        for k in range(1, longest)
    ]
    cuts = reduce(DataFrame.unionByName, cut_at)
    parts = common.where("size >= 1").select("key", "a")
    fits = fits_broadcast(parts)
    joined = lookup_join(cuts, parts.toDF("left", "l"), "left", fits=fits)
    joined = lookup_join(joined, parts.toDF("right", "r"), "right", fits=fits, counted=cuts)
    key = F.concat("left", F.lit(" "), _phrase(F.col("right"))).alias("key")
    best = joined.withColumn("score", score()).groupBy(key, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    named = best.select(_lang(F.col("key")).alias("lang"), _phrase(F.col("key")).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = first_n_per_group(named, ["lang"], order, top)
    total = common.where("size = 0").select(_lang(F.col("key")).alias("lang"), F.col("a").alias("n"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return lookup_join(ranked, total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
