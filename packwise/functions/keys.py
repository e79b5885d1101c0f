"""Keys of one table looked for in another, before rows move to a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

#: Keys are told apart by so many bits of their hash.
MAP_BITS = 27


def perhaps_among(rows: DataFrame, others: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among those of ``others``, and the rows whose key isn't.

    The keys are a bit map of 2^MAP_BITS hashes (16 MB, sent to every task), whatever their number, so the first
    rows alone have to move to a join. Keys whose equal values may have other hashes are all among the first.
    """
    kinds = {df.schema[key].dataType for df in (rows, others)}
    if len(kinds) > 1 or not isinstance(*kinds, (IntegralType, StringType)):
        return rows, rows.limit(0)
    place = F.shiftrightunsigned(F.xxhash64(key), 64 - MAP_BITS)
    line, bit = F.shiftright(place, 15), place % (1 << 15)
    lines = others.select(line.alias("_line"), bit.alias("_bit")).groupBy("_line").agg(
        F.bitmap_construct_agg("_bit").alias("_bits"))
    found = rows.withColumns({"_line": line, "_bit": bit}).join(F.broadcast(lines), "_line", "left")
    hit = F.coalesce(_bit(F.col("_bits"), F.col("_bit")) == 1, F.lit(False))
    return found.where(hit).select(*rows.columns), found.where(~hit).select(*rows.columns)


def _bit(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10)
    return F.call_function("shiftright", byte.cast("int"), (place % 8).cast("int")).bitwiseAND(1)
