"""Joins and rankings that hold when one key owns a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagescout import settings as S
from pagescout.storage import materialize


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    key: str,
    broadcast_limit: int = S.BROADCAST_LIMIT_BYTES,
    rows_per_task: int = S.ROWS_PER_TASK,
    fits: bool | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Left join of a large table with a lookup table that has one row per ``key``.

    The lookup is measured first. Up to ``broadcast_limit`` bytes it is broadcast and the
    large side does not move. Beyond that the join is a shuffle in which every key with more
    than ``rows_per_task`` rows is spread over several tasks. ``fits`` is the result of
    :func:`fits_broadcast` where it is known already; ``counted`` has the same keys as often as ``left``, where
    counting them there is cheaper.
    """
    if fits is None:
        fits = fits_broadcast(lookup, broadcast_limit)
    if fits:
        return left.join(F.broadcast(lookup), key, "left")
    return salted_join(left, lookup, key, rows_per_task, counted)


def fits_broadcast(df: DataFrame, limit: int = S.BROADCAST_LIMIT_BYTES) -> bool:
    """Whether the rows, measured as JSON text with a margin, stay below the limit."""
    size = F.sum(F.length(F.to_json(F.struct(*df.columns))).cast("long") * 2 + 64)
    return df.agg(F.coalesce(size, F.lit(0))).first()[0] <= limit


def salted_join(left: DataFrame, lookup: DataFrame, key: str, rows_per_task: int, counted: DataFrame | None = None) -> DataFrame:
    """Left join in which hot keys are split into as many parts as their row count asks for.

    The keys are counted in ``counted`` if it is given, else in ``left``, which is computed twice then. Only keys above ``rows_per_task`` are split, so there are at most
    ``rows / rows_per_task`` of them: that list is small by construction and is broadcast.
    """
    hot = (
        (left if counted is None else counted).groupBy(key)
        .count()
        .where(F.col("count") > rows_per_task)
        .select(F.col(key), F.ceil(F.col("count") / rows_per_task).cast("int").alias("_parts"))
    )
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    # NULL matches nothing in the lookup, but its rows have to be spread all the same.
    hot_key = hot.withColumnRenamed(key, "_hot_key")
    spread = left.join(F.broadcast(hot_key), F.col(key).eqNullSafe(F.col("_hot_key")), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int")
    ).drop("_hot_key")
    copies = lookup.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    # Spark would take the copies for as small as the file of the lookup, and broadcast what does not fit.
    return spread.drop("_parts").join(copies.drop("_parts").hint("merge"), [key, "_salt"], "left").drop("_salt")


def first_n_per_group(
    df: DataFrame, group: list[str], order: list[Column], n: int, parts: int = 64
) -> DataFrame:
    """At most ``n`` rows per group in the given order, exact.

    Two rounds: the first keeps ``n`` rows of each of ``parts`` slices of a group, so the
    second sees at most ``parts * n`` rows of even the largest group.
    """
    slice_no = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    first = Window.partitionBy(*group, "_slice").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_slice", slice_no)
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(final))
        .where(F.col("_rank") <= n)
        .drop("_slice", "_rank")
    )


def rank_in_group(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds the 1-based rank of each row in its group, without holding a group in one task.

    The rows are range-sorted by group and order, so a large group covers several
    partitions. A rank is the row's place in its partition plus the group's rows in earlier
    partitions; only those counts, one row per group and partition, meet in a window.
    Rows must be distinct in ``group`` and ``order``.
    """
    # The sorted rows are written with their place, as both branches below must see the same.
    placed = materialize(
        df.orderBy(group, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id()),
        "ranked",
    )
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(group, "_part")
        .agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    rank = F.col("_place") - F.col("_first") + F.col("_before") + 1
    return placed.join(offsets, [group, "_part"]).select(*df.columns, rank.alias(name))
