"""Chains of pages (H10, H11): series of "next" pages and pages that name each other as canonical.

A chain is followed by pointer doubling: every round, each page learns from the page it points to how
far that one has come, so a chain of n pages takes log2(n) joins of narrow rows and no task walks it.
Pages that still point on when a round settles no further page lie on a loop or lead into one: on a
chain, some page always stands just beyond those that a round reaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescout import settings as S
from pagescout.operators.skew import lookup_join, salted_join
from pagescout.storage import materialize


def _double(state: DataFrame, open_rows: DataFrame, name: str) -> DataFrame:
    """One round: open rows take over where the row they point to has come."""
    ahead = state.select(
        F.col("page").alias("far"), F.col("far").alias("_far"), F.col("steps").alias("_steps"), F.col("least").alias("_least"), F.col("done").alias("_done")
    )
    stepped = salted_join(open_rows, ahead, "far", S.ROWS_PER_TASK).select(
        "page",
        F.col("_far").alias("far"),
        (F.col("steps") + F.col("_steps")).alias("steps"),
        F.least("least", "_least").alias("least"),
        F.col("_done").alias("done"),
    )
    return materialize(state.join(open_rows.select("page"), "page", "left_anti").unionByName(stepped), name)


def _settled(state: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """Rounds until no further row is done: the state, the rounds made, the rows that are on loops or lead there."""
    state, before, rounds = materialize(state, name), None, 0
    while True:
        rest = state.where(~F.col("done")).count()
        if rest in (0, before):
            return state, rounds, rest
        state, before, rounds = _double(state, state.where(~F.col("done")), name), rest, rounds + 1


def follow_next(links: DataFrame) -> DataFrame:
    """``(page, head, position, is_loop)`` for every page of ``links(src, dst)``, each page once.

    Of several next pages of a page the smallest URL counts, and of several pages before a page likewise. Positions
    start at 1 with the head of the series. Pages on a loop have neither.
    """
    chosen = links.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).groupBy("src").agg(F.min("dst").alias("dst"))
    before = chosen.groupBy(F.col("dst").alias("page")).agg(F.min("src").alias("before"))
    pages = chosen.select(F.col("src").alias("page")).union(links.select("dst")).where("page IS NOT NULL").distinct()
    first = F.col("before").isNull()
    state = pages.join(before, "page", "left").select(
        "page",
        F.coalesce("before", "page").alias("far"),
        F.when(first, 0).otherwise(1).cast("long").alias("steps"),
        F.col("page").alias("least"),
        first.alias("done"),
    )
    state, _, _ = _settled(state, "series")
    done = F.col("done")
    return state.select(
        "page", F.when(done, F.col("far")).alias("head"), F.when(done, F.col("steps") + 1).alias("position"), (~done).alias("is_loop")
    )


def resolve_canonicals(canonicals: DataFrame) -> DataFrame:
    """``(url_key, representative, hops, is_loop, conflict)`` of every page that names a canonical URL.

    The representative is where the chain of canonicals ends: a page that names itself or none. Pages that are on a loop,
    or lead to one, have the smallest URL of the loop and no hops. Copies of a page that name different
    URLs are a conflict; the smallest of them counts.
    """
    named = canonicals.groupBy("url_key").agg(F.min("canonical").alias("canonical"), (F.min("canonical") != F.max("canonical")).alias("conflict"))
    named = materialize(named, "canonicals")
    goes_on = named.select(F.col("url_key").alias("canonical"), F.lit(True).alias("goes_on"))
    itself = F.col("canonical") == F.col("url_key")
    state = salted_join(named, goes_on, "canonical", S.ROWS_PER_TASK).select(
        F.col("url_key").alias("page"),
        F.col("canonical").alias("far"),
        F.when(itself, 0).otherwise(1).cast("long").alias("steps"),
        F.col("url_key").alias("least"),
        (itself | F.col("goes_on").isNull()).alias("done"),
    )
    state, rounds, rest = _settled(state, "canonical-chains")
    # Once a step is as long as all that is left, it ends on the loop, and has seen all of the loop from there.
    while 1 << rounds < rest:
        state, rounds = _double(state, state.where(~F.col("done")), "canonical-loops"), rounds + 1
    done = F.col("done")
    loops = state.where(~done).select(F.col("page").alias("far"), F.col("least").alias("loop_least"))
    found = lookup_join(state, loops, "far").select(
        F.col("page").alias("url_key"),
        F.when(done, F.col("far")).otherwise(F.col("loop_least")).alias("representative"),
        F.when(done, F.col("steps")).alias("hops"),
        (~done).alias("is_loop"),
    )
    return found.join(named.select("url_key", "conflict"), "url_key")


def products_by_representative(products: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(representative, products, first_product)``: product pages ``(url_key)`` that are one product.

    A product page without a canonical URL represents itself.
    """
    one = products.select("url_key").distinct().join(resolved.select("url_key", "representative"), "url_key", "left")
    return one.groupBy(F.coalesce("representative", "url_key").alias("representative")).agg(
        F.count("*").alias("products"), F.min("url_key").alias("first_product")
    )
