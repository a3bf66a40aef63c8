"""Values inherited along chains of frames, resolved in a logarithmic number of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def inherit(frames: DataFrame, stream: str, frame: str, source: Column, value: Column, name: str) -> DataFrame:
    """``frames`` with ``name``: a frame's own ``value``, or that of the first frame with one along its sources.

    Each step replaces every open frame's source by its source's source, so a
    chain of n frames takes log2(n) steps, each a join of stored tables that
    Spark splits where many frames share a source.  A frame whose chain ends
    without a value, or runs in a circle, gets null.
    """
    now = materialise(frames.select(F.col(stream).alias("stream"), F.col(frame).alias("frame"), F.when(value.isNull(), source).alias("up"), F.struct(value.alias("v")).alias("held")), "chains")
    kept = materialise(frames, "frames")
    known = F.col("held.v").isNotNull() | F.col("up").isNull()
    open_rows = now.filter(~known).count()
    while open_rows:
        above = now.select(F.col("stream").alias("__s"), F.col("frame").alias("__f"), F.col("up").alias("__up"), F.col("held").alias("__held"))
        moved = now.filter(~known).join(above, F.col("stream").eqNullSafe(F.col("__s")) & (F.col("up") == F.col("__f")), "left")
        moved = moved.select("stream", "frame", F.col("__up").alias("up"), F.coalesce("__held", "held").alias("held"))
        now = materialise(now.filter(known).unionByName(moved), "chains")
        left = now.filter(~known).count()
        if left == open_rows:  # circles only
            break
        open_rows = left
    found = now.select(F.col("stream").alias("__s"), F.col("frame").alias("__f"), F.col("held.v").alias(name))
    same = F.col(stream).eqNullSafe(F.col("__s")) & (F.col(frame) == F.col("__f"))
    return kept.drop(name).join(found, same, "left").drop("__s", "__f")
