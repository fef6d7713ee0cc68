"""Quality rules: how far a document is from how its language is written.

Two histograms are compared with those of each language by Jensen-Shannon distance: classes of
characters, and common words. A document fails if it is far from every language. Texts that are
too short for a histogram are not judged by it, nor are those of a language with too little text
for a reference. Expressions only; nothing is shuffled but the sums that make the references.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescout.functions.steps import settle
from pagescout.llm.texts import spaced_words
from pagescout.storage import materialize

#: Common words of English, German, French and Spanish, each list by frequency.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou mais",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este porque esta",
}
#: Classes of characters in the order in which they are counted.
CLASSES = ["[a-z]+", "[\\x20\\x09-\\x0D]+", "[A-Z]+", "[^\\x00-\\x7F]+", "[0-9]+", "[.,;:'\"?!()\\-]+"]
_SYMBOLS = "[#*$%&|<>]+"


@dataclass(frozen=True)
class Limits:
    """Largest distances from the nearest language, and the sizes below which a histogram says nothing."""

    chars: float = 0.28
    words: float = 0.31
    least_chars: int = 200
    least_words: int = 120
    #: A language is a reference if its good documents have so many words, whatever else is in the table.
    least_reference_words: int = 5000


#: References that are broadcast at one time, about 1 KB each; more of them are met in several passes.
LANGUAGES_AT_ONCE = 10_000


def common_words() -> list[str]:
    return sorted({w for words in COMMON.values() for w in words.split()})


def _divergence(p: Column, q: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2

    def half(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m) / 2).otherwise(F.lit(0.0))

    return half(p) + half(q)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts and both histograms, in columns that start with ``_``.

    ``_seen`` holds the common words that occur, as places in :func:`common_words` from 1, with their counts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns({"_words": spaced_words(F.col(text_col)), "_r0": text})
    for i, kind in enumerate(CLASSES):
        out = out.withColumn(f"_r{i + 1}", F.regexp_replace(f"_r{i}", kind, ""))
    rest = f"_r{len(CLASSES)}"
    sizes = [F.char_length(f"_r{i}") - F.char_length(f"_r{i + 1}") for i in range(len(CLASSES))]
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    common = common_words()
    out = out.withColumns({
        "_chars": F.array(*sizes, F.char_length(rest)),
        "_symbols": F.char_length(rest) - F.char_length(F.regexp_replace(rest, _SYMBOLS, "")),
        "_lines": lines,
        "_ids": F.sort_array(F.transform(
            F.filter(spaced_words(F.lower(F.col(text_col))), lambda w: w.isin(common)),
            lambda w: F.array_position(F.array(*map(F.lit, common)), w).cast("int"),
        )),
    })
    out = settle(out.drop(*[f"_r{i}" for i in range(len(CLASSES) + 1)]), "_words", "_chars", "_symbols", "_lines", "_ids")
    # In a sorted array a value's run ends where the next value's begins.
    out = settle(out.withColumn("_distinct", F.array_distinct("_ids")), "_distinct")
    first = settle(out.withColumn("_first", F.transform("_distinct", lambda d: F.array_position("_ids", d))), "_first")
    runs = F.transform(
        "_distinct",
        lambda d, i: F.struct(d.alias("id"), (F.coalesce(F.get("_first", i + 1), F.size("_ids") + 1) - F.get("_first", i)).cast("long").alias("n")),
    )
    out = first.withColumns({"_seen": runs, "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    # Nothing repeats in most texts; only where something does are windows sorted.
    window = F.transform(F.sequence(F.lit(1), F.size("_words") - 7), lambda i: F.xxhash64(F.slice("_words", i, 8)))
    out = settle(out.withColumn("_windows", F.when(F.size("_words") >= 8, window)), "_windows", "_seen")
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = settle(out.withColumn("_pairs", F.when(repeats, pairs)).drop("_windows"), "_pairs")

    def again(p: Column, i: Column) -> Column:
        before, after = F.get("_pairs", i - 1)["h"], F.get("_pairs", i + 1)["h"]
        return F.coalesce(before == p["h"], F.lit(False)) | F.coalesce(after == p["h"], F.lit(False))

    out = settle(out.withColumn("_places", F.sort_array(F.transform(F.filter("_pairs", again), lambda p: p["i"]))).drop("_pairs"), "_places")
    covered = F.aggregate(
        F.transform("_places", lambda p, i: F.least(F.lit(8), F.coalesce(F.get("_places", i + 1) - p, F.lit(8)))), F.lit(0), lambda a, b: a + b
    )
    return out.withColumns({
        "_n_words": F.size("_words").cast("long"),
        "_n_common": F.size("_ids").cast("long"),
        "_word_chars": (F.aggregate("_chars", F.lit(0), lambda a, b: a + b) - F.get("_chars", F.lit(1))).cast("long"),
        "_n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).withColumn("_base_failed", (F.col("_n_words") < 20) | (100 * F.col("_n_repeat_words") > 30 * F.col("_n_words")))


def references(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``lang, chars, words``: a language's share of each class of characters, and of each common word after all other words.

    Sums over all rows of :func:`measure` (with their ``_lang``) that pass the base rules and are
    long enough. A language with fewer than ``least_reference_words`` words in them has no row.
    """
    good = measured.where(F.col("_lang").isNotNull() & ~F.col("_base_failed") & (F.col("_n_words") >= limits.least_words))
    narrow = good.select(F.col("_lang").alias("lang"), "_chars", "_n_words", "_seen")
    bins = F.concat(
        F.transform("_chars", lambda c, i: F.struct((-1 - i).alias("bin"), c.cast("long").alias("n"))),
        F.transform("_seen", lambda s: F.struct(s["id"].alias("bin"), s["n"].alias("n"))),
        F.array(F.struct(F.lit(0).alias("bin"), F.col("_n_words").alias("n"))),
    )
    sums = narrow.select("lang", F.inline(bins)).groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    per_language = sums.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("bins"))

    def total(ns: Column) -> Column:
        return F.aggregate(ns, F.lit(0).cast("long"), lambda a, b: a + b)

    def counts(first: int, last: int) -> Column:
        return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: F.coalesce(F.element_at("bins", i), F.lit(0).cast("long")))

    n = F.element_at("bins", F.lit(0))
    rows = per_language.where(n >= limits.least_reference_words).select(
        "lang", n.alias("n"), counts(-1, -1 - len(CLASSES)).alias("chars"), counts(1, len(common_words())).alias("words")
    )
    return rows.select(
        "lang",
        F.transform("chars", lambda c: c / total(F.col("chars"))).alias("chars"),
        F.concat(F.array((F.col("n") - total(F.col("words"))) / F.col("n")), F.transform("words", lambda w: w / F.col("n"))).alias("words"),
    )


def judge(measured: DataFrame, known: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The columns of ``row`` and the verdict on each row of :func:`measure`, against the languages of ``known``."""
    known = materialize(known, "references")
    passes = max(1, -(-known.count() // LANGUAGES_AT_ONCE))

    def root(x: Column) -> Column:
        return F.sqrt(F.greatest(x, F.lit(0.0)))

    total = F.greatest(F.col("_word_chars") + F.get("_chars", F.lit(1)), F.lit(1))
    n = F.greatest(F.col("_n_words"), F.lit(1))
    out = measured.withColumns({
        "_p": F.transform("_chars", lambda c: c / total),
        "_q": F.transform("_seen", lambda s: F.struct(s["id"].alias("id"), (s["n"] / n).alias("p"))),
        "_rest": (F.col("_n_words") - F.col("_n_common")) / n,
        "_near": F.lit(None).cast("struct<both: double, chars: double, words: double>"),
        "_own": F.col("_lang").isNull(),
    })
    out = settle(out, "_p", "_q", "_rest", "_near", "_own")

    def distances(ref: Column) -> Column:
        by_char = F.aggregate(F.zip_with("_p", ref["chars"], _divergence), F.lit(0.0), lambda a, x: a + x)
        seen = F.aggregate("_q", F.lit(0.0), lambda a, s: a + _divergence(s["p"], F.get(ref["words"], s["id"])))
        met = F.aggregate("_q", F.lit(0.0), lambda a, s: a + F.get(ref["words"], s["id"]))
        other = F.get(ref["words"], F.lit(0))
        # A word that does not occur adds half of its share.
        by_word = seen + _divergence(F.col("_rest"), other) + (1 - other - met) / 2
        return F.struct(root(by_char).alias("chars"), root(by_word).alias("words"))

    def nearest(refs: Column) -> Column:
        both = F.transform(F.transform(refs, distances), lambda d: F.struct((d["chars"] + d["words"]).alias("both"), d["chars"], d["words"]))
        return F.array_min(F.array("_near", F.array_min(both).cast(out.schema["_near"].dataType)))

    for i in range(passes):
        part = known.where(F.pmod(F.xxhash64("lang"), F.lit(passes)) == i).agg(F.collect_list(F.struct("lang", "chars", "words")).alias("_refs"))
        met = out.crossJoin(F.broadcast(part))
        own = F.col("_own") | F.array_contains(F.col("_refs.lang"), F.coalesce("_lang", F.lit("")))
        out = settle(met.withColumns({"_near": nearest(F.col("_refs")), "_own": own}).drop("_refs"), "_near", "_own")
        if i + 1 < passes:
            out = materialize(out, "nearest")
    far_chars = (F.col("_word_chars") + F.get("_chars", F.lit(1)) >= limits.least_chars) & (F.col("_near.chars") > limits.chars)
    far_words = (F.col("_n_words") >= limits.least_words) & (F.col("_near.words") > limits.words)
    return out.select(
        "row.*",
        F.col("_n_words").alias("n_words"),
        F.col("_word_chars").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        F.col("_n_dup_lines").alias("n_dup_lines"),
        F.col("_n_repeat_words").alias("n_repeat_words"),
        F.col("_base_failed").alias("base_failed"),
        F.round("_near.chars", 6).alias("char_distance"),
        F.round("_near.words", 6).alias("word_distance"),
        (~F.col("_base_failed") & ~(F.col("_own") & F.coalesce(far_chars | far_words, F.lit(False)))).alias("kept"),
    )


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]


def apply_rules(docs: DataFrame, limits: Limits = Limits(), lang_col: str = "lang", text_col: str = "text", known: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept``.

    The distances are those from the language for which their sum is least, NULL if there is no
    reference. References are ``known`` or come from the documents themselves; rows with a NULL
    language are judged but make no reference. Rows of a language without a reference have
    distances, but only the base rules decide about them. NULL and empty texts have no words and fail. Rows
    are judged one by one; the added columns replace columns of the same names. The text is
    measured once. ``keep`` names the columns of ``docs`` to return, all by default.
    """
    names = [c for c in keep or docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*names).alias("row"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("text"))
    measured = measure(rows).drop("text", "_words", "_lines", "_places", "_distinct", "_first", "_ids")
    if known is None:
        measured = materialize(measured, "measured")
        known = references(measured, limits)
    return judge(measured, known, limits)
