"""Line dedup over the whole collection by a deletion-neighbourhood join.

Two lines are near when one word inserted, deleted or replaced makes one the other. A line of
fewer than ``MIN_WORDS`` words, such as text without spaces, is compared by characters with others
like it if it has ``MIN_CHARACTERS`` of them, else only as it stands. Every line
emits what is left of it without each one word, and itself, as hashed keys that also name the
place of the missing word; all lines that share a key are near one another, so it is enough to
compare each with the earliest of its key, word by word.

Before that, a line is dropped from the join if neither its first nor its second half stands in
another line: one edit leaves one half whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescout import settings as S
from pagescout.functions.steps import settle
from pagescout.llm.texts import spaced_words
from pagescout.operators.skew import fits_broadcast, lookup_join, rank_in_group
from pagescout.storage import materialize

MIN_WORDS, MIN_CHARACTERS = 6, 24


def units(text: Column) -> Column:
    """What edits of a line are counted in: its words; of a line with few words its characters, each behind a line feed, which no word has."""
    words = spaced_words(text)
    characters = F.transform(F.split(text, ""), lambda c: F.concat(F.lit("\n"), c))
    return F.when(F.size(words) >= MIN_WORDS, words).when(F.char_length(text) >= MIN_CHARACTERS, characters)


def _with_halves(lines: DataFrame) -> DataFrame:
    """Adds ``halves``: keys of leading and trailing halves by which a line meets lines of its length, one more or one less.

    They are cut from the text itself; words are split later, for the few lines that meet another.
    """
    text, plain = F.col("text"), F.col("_plain")
    odd = text.contains("  ") | text.startswith(" ") | text.endswith(" ")
    for white in "\t\x0b\x0c\r":
        odd = odd | text.contains(white)
    one_space = F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))
    out = settle(lines.withColumn("_plain", F.when(odd, one_space).otherwise(text)), "_plain")
    n_words = F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(" "), F.lit(""))) + 1
    out = settle(out.withColumn("_n_words", n_words), "_n_words")
    worded = F.col("_n_words") >= MIN_WORDS
    out = settle(out.withColumn("_n", F.when(worded, F.col("_n_words")).otherwise(F.char_length(text))), "_n")
    n, even = F.col("_n"), F.col("_n") % 2 == 0

    def cut(kind: int, k: Column) -> Column:
        k = k.cast("int")
        lead, sign = kind == 1, F.lit(1 if kind == 1 else -1)
        some = F.substring(text, F.lit(1) if lead else -k, k)
        return F.xxhash64(F.lit(kind), worded, F.when(worded, F.call_function("substring_index", plain, F.lit(" "), k * sign)).otherwise(some))

    keys = F.array(
        cut(1, F.floor(n / 2)),
        cut(2, F.ceil(n / 2)),
        F.when(even, cut(1, n / 2 - 1)).otherwise(cut(2, (n - 1) / 2)),
    )
    return out.withColumn("halves", F.when(worded | (n >= MIN_CHARACTERS), keys)).drop("_plain", "_n_words", "_n")


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def _by_step(hashes: Column, step: Column) -> Column:
    """Sums of the elements of each step."""
    starts = F.sequence(F.lit(0), F.ceil(F.size(hashes) / step).cast("int") - 1)
    return F.transform(starts, lambda i: _xor(F.slice(hashes, i * step + 1, step)))


def _up_to_each(sums: Column) -> Column:
    """Sums of what stands before each element, and of all."""
    return F.transform(F.sequence(F.lit(0), F.size(sums)), lambda i: _xor(F.slice(sums, F.lit(1), i)))


def variants(lines: DataFrame) -> DataFrame:
    """``key, place, size`` beside the columns of ``lines``, which has ``words``.

    A key is the exclusive or of hashes of word and place. Taking a word out moves those behind it
    by one place, so the key of a variant is what stands before it, at its place, and what stands
    behind it, one place less. Sums over steps of about the root of the length keep the work
    for very long lines far below the square of their length.
    """
    n, step = F.size("words"), F.col("_step")
    at_place = F.transform("words", lambda w, i: F.xxhash64(w, i))
    one_less = F.transform("words", lambda w, i: F.xxhash64(w, i - 1))
    out = settle(lines.withColumns({"_a": at_place, "_b": one_less, "_step": F.greatest(F.lit(1), F.sqrt(n).cast("int"))}), "_a", "_b", "_step")
    for x in ("_a", "_b"):
        out = settle(out.withColumn(f"{x}_steps", _by_step(F.col(x), step)), f"{x}_steps")
        out = settle(out.withColumn(f"{x}_before", _up_to_each(F.col(f"{x}_steps"))), f"{x}_before")

    def up_to(x: str, i: Column) -> Column:
        k = F.floor(i / step).cast("int")
        return F.get(f"{x}_before", k).bitwiseXOR(_xor(F.slice(x, k * step + 1, i % step)))

    whole = F.get("_a_before", F.size("_a_before") - 1)
    behind = F.get("_b_before", F.size("_b_before") - 1)
    places = F.sequence(F.lit(0), n - 1)
    without = F.transform(places, lambda i: F.struct(up_to("_a", i).bitwiseXOR(behind.bitwiseXOR(up_to("_b", i + 1))).alias("key"), i.alias("place"), (n - 1).alias("size")))
    itself = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(whole.alias("key"), i.alias("place"), n.alias("size")))
    return out.withColumn("_v", F.explode(F.concat(without, itself))).select(*lines.columns, "_v.*")


def _left(words: Column, place: Column, size: Column) -> Column:
    """A line's words without the one at ``place`` if it has more than ``size``."""
    cut = F.concat(F.slice(words, F.lit(1), place), F.slice(words, place + 2, F.greatest(F.size(words) - place - 1, F.lit(0))))
    return F.when(F.size(words) > size, cut).otherwise(words)


def _row(id_col: str, text_col: str) -> Column:
    """A name of a document by id and text."""
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")))
    return F.unhex(F.md5(name.cast("binary")))


def _lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``line, text, at``: every line that has a word; ``at`` orders by id (NULL last), text and number."""
    # The row is named before its lines are listed: behind that it would be hashed for each line.
    rows = docs.select(F.col(id_col).alias("id"), _row(id_col, text_col).alias("_row"), _lines_of(F.col(text_col)).alias("_lines"))
    return (
        rows.select("id", "_row", F.posexplode("_lines").alias("_no", "text"))
        .where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
        .select(
            F.unhex(F.md5(F.col("text").cast("binary"))).alias("line"),
            "text",
            F.struct(F.col("id").isNull().alias("none"), "id", "_row", "_no").alias("at"),
        )
    )


def _by_size(rows: DataFrame) -> DataFrame:
    """``rows`` for a join: broadcast if they are measured as few, by shuffle else, never as Spark guesses.

    Spark takes the rows behind an explode, and lists of words, for as small as the file they come from, and
    keeps a broadcast that it has planned even if the rows turn out to be many: the driver would have to hold them.
    """
    return F.broadcast(rows) if fits_broadcast(rows) else rows.hint("merge")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row, removed``: numbers of the lines of each document that repeat an earlier line.

    A line stays where it is first found, unless an earlier line is near it: then it goes everywhere.
    """
    # The text of a line is not shuffled, only its keys are.
    lines = materialize(
        _with_halves(_occurrences(docs, id_col, text_col))
        .select("line", "at", "halves")
        .groupBy("line")
        .agg(F.min("at").alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves")),
        "lines",
    )
    halves = lines.select("line", F.explode("halves").alias("half"))
    number = halves.select("half", F.xxhash64("line").alias("number"))
    shared = number.groupBy("half").agg(F.min("number").alias("a"), F.max("number").alias("b")).where("a != b").select("half")
    shared = materialize(shared, "shared-halves")
    candidates = materialize(halves.join(_by_size(shared), "half", "left_semi").select("line").distinct(), "candidates")
    candidate_lines = (
        _occurrences(docs, id_col, text_col)
        .join(_by_size(candidates), "line", "left_semi")
        .groupBy("line")
        .agg(F.min("at").alias("first"), F.first("text").alias("text"))
        .select("line", "first", units(F.col("text")).alias("words"), F.lit("all").alias("_all"))
    )
    # Lines are numbered in order, so the many rows below carry two numbers and no place.
    near_lines = materialize(rank_in_group(candidate_lines, "_all", ["first"], "id"), "near-lines")
    keyed = variants(near_lines.select("id", "words")).select("key", "place", "size", "id")
    group = ["key", "place", "size"]
    heads = keyed.groupBy(*group).agg(F.min("id").alias("head"), F.max("id").alias("_last")).where("head < _last")
    heads = materialize(heads.select(*group, "head"), "heads")
    pairs = (
        keyed.join(_by_size(heads), group)
        .where(F.col("id") != F.col("head"))
        .groupBy("id", "head")
        .agg(F.min(F.struct("place", "size")).alias("_v"))
    )
    pairs = materialize(pairs, "pairs")
    ours = near_lines.select("id", "line", F.col("words").alias("_mine"))
    theirs = near_lines.select(F.col("id").alias("head"), F.col("words").alias("_theirs"))
    same = _left(F.col("_mine"), F.col("_v.place"), F.col("_v.size")) == _left(F.col("_theirs"), F.col("_v.place"), F.col("_v.size"))
    # Both sides have words here, which Spark takes for far smaller than they are.
    both = _by_size(pairs).join(ours, "id").join(theirs.hint("merge"), "head")
    near = materialize(both.where(same).select("line").distinct().withColumn("near", F.lit(True)), "near")
    dirty = (
        lines.select("line", "n", F.col("first._row").alias("_first_row"), F.col("first._no").alias("_first_no"))
        .join(_by_size(near), "line", "left")
        .where("near or n > 1")
        .withColumn("near", F.coalesce("near", F.lit(False)))
    )
    dirty = materialize(dirty, "dirty")
    places = _occurrences(docs, id_col, text_col).select("line", F.col("at._row").alias("_row"), F.col("at._no").alias("_no"))
    if fits_broadcast(dirty):
        met = places.join(F.broadcast(dirty), "line")
    else:
        # A line found more often than a task should read is dealt to several; there are few such lines.
        parts = F.ceil(F.col("n") / S.ROWS_PER_TASK).cast("int")
        often = dirty.where(F.col("n") > S.ROWS_PER_TASK).select("line", parts.alias("_parts"))
        salt = F.pmod(F.xxhash64("_row", "_no"), F.coalesce("_parts", F.lit(1))).cast("int")
        dealt = places.join(F.broadcast(often), "line", "left").withColumn("_salt", salt).drop("_parts")
        met = dealt.join(dirty.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).hint("merge"), ["line", "_salt"])
    return (
        met.where(F.col("near") | (F.col("_row") != F.col("_first_row")) | (F.col("_no") != F.col("_first_no")))
        .groupBy("_row")
        .agg(F.collect_set("_no").alias("removed"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and ``n_lines, n_removed``.

    ``n_lines`` counts lines with a word; blank lines stay where they are. NULL stays NULL. Rows that
    repeat id and text are one document and come out alike. The two counts replace columns of
    the same names. An empty table gives an empty result.
    """
    removed = materialize(repeated_lines(docs, id_col, text_col).withColumnRenamed("removed", "_removed"), "removed")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # Lines are split again behind the join, so that a join by shuffle moves the text once.
    rows = lookup_join(docs.select(F.struct(*kept).alias("row"), _row(id_col, text_col).alias("_row")), removed, "_row")
    rows = settle(rows.select("row", "_removed", _lines_of(F.col("row")[text_col]).alias("_lines")), "_lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_removed"))
    text = F.when(F.col("_removed").isNull(), F.col("row")[text_col]).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    )
    worded = F.size(F.filter("_lines", lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    return rows.select(
        *[(text if c == text_col else F.col("row")[c]).alias(c) for c in kept],
        worded.cast("long").alias("n_lines"),
        F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"),
    )
