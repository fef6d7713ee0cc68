"""A bit filter in front of the text: which rows may have a key of a set that is too large to broadcast.

The set becomes bitmaps of bounded total size, built in tasks and united by bucket. They are broadcast, and the
large side is cut down in place, before anything of it moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagescout import settings as S

#: Bits in one bitmap of the built-in aggregate (fixed).
_BITMAP = 32_768


def _places(key: Column, bits: int) -> list[Column]:
    """Two places of a key in the filter."""
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) + 1 for seed in (0, 1)]


def key_bits(keys: DataFrame, key: str) -> DataFrame:
    """``(bucket, bitmap, bits)``: a filter that lets every non-NULL key pass.

    16 bits a key, at most ``S.FILTER_BITS`` (16 MB) in all; beyond some ten million keys it lets more and more other keys pass.
    """
    count = keys.count()
    bits = min(max(_BITMAP, 1 << (16 * count).bit_length()), S.FILTER_BITS)
    place = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), bits))).alias("place"))
    return (
        place.groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
        .withColumn("bits", F.lit(bits).cast("long"))
    )


def may_match(df: DataFrame, key: str, filter_: DataFrame) -> DataFrame:
    """The rows whose ``key`` the filter lets pass: all that are in the set, few that are not, none with NULL."""
    bits = filter_.select("bits").first()
    if bits is None:
        return df.where("false")
    columns = df.columns
    for i, place in enumerate(_places(F.col(key), bits[0])):
        name = f"_bits_{i}"
        bitmap = F.broadcast(filter_.select(F.col("bucket").alias(f"{name}_bucket"), F.col("bitmap").alias(name)))
        at = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substring(F.col(name), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1
        # Buckets are unique, so this keeps each row once; a semi join would be moved below unions, out of reach of the hint.
        df = df.join(bitmap, (F.bitmap_bucket_number(place) == F.col(f"{name}_bucket")) & is_set & F.col(key).isNotNull())
    return df.select(*columns)
