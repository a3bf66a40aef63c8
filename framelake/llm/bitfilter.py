"""A filter of fixed size over key hashes, in DataFrame operations only.

``build`` sets one bit for each key; ``test`` keeps the rows whose bit is set.
The table that is broadcast has at most ``bits / 64`` rows, whatever the input,
so its size is bounded by a parameter.  A full filter lets every row through:
what follows must decide exactly, and does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 22


def _place(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits))


def build(keys: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """(__word, __bits) of the rows of ``keys``; ``key`` is a 64-bit hash."""
    place = keys.select(_place(key, bits).alias("__p"))
    bit = F.expr("shiftleft(1L, cast(__p & 63 as int))")
    return place.groupBy(F.shiftright("__p", 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))


def test(rows: DataFrame, key: Column, built: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """``rows`` with the boolean column ``name``: whether the key may be among those built in."""
    rows = rows.withColumn("__p", _place(key, bits)).withColumn("__word", F.shiftright("__p", 6))
    rows = rows.join(F.broadcast(built), "__word", "left")
    hit = F.expr("(shiftright(__bits, cast(__p & 63 as int)) & 1) = 1")
    return rows.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__p", "__word", "__bits")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone`` (a stored table), in two parts: most pass where they are, the others are joined."""
    hashed = F.xxhash64(key)
    marked = test(rows, hashed, build(gone, hashed), "__in")
    maybe = marked.filter("__in").drop("__in").join(gone, key, "left_anti")
    return marked.filter(~F.col("__in")).drop("__in").unionByName(maybe)
