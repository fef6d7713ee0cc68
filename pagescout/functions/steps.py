"""Compute a column once; find a place in a sorted array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns computed here and nowhere else.

    The optimizer moves filters towards the scan and replaces column names by their
    definitions on the way. For columns built in many steps that repeats the whole
    computation inside the filter. A one-row generator ends the substitution and costs
    nothing but itself, inside the same generated code.
    """
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(F.struct(*names))))


def count_up_to(entries: Column, key: Column, value: Callable[[Column], Column] = lambda e: e) -> Column:
    """How many entries of a sorted array are not above ``key``, found by halving."""
    size = F.size(entries)

    def halve(state: Column, _: Column) -> Column:
        middle = ((state["low"] + state["high"] + 1) / 2).cast("int")
        below = value(entries[middle - 1]) <= key
        done = state["low"] >= state["high"]
        return F.struct(
            F.when(~done & below, middle).otherwise(state["low"]).alias("low"),
            F.when(~done & ~below, middle - 1).otherwise(state["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(1), F.length(F.bin(size)))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), size.alias("high")), halve, lambda state: state["low"])
