"""Benchmark statistics: budgets, quarters, counterbalanced runs, spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .ordering import running_sum


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def frame_budget(frames: DataFrame, stream: str, us: Column) -> DataFrame:
    """Milliseconds between frames, from the first to the last timestamp; null for a single frame."""
    n = F.count("*")
    span = F.max(us) - F.min(us)
    return frames.groupBy(stream).agg(n.alias("frames"), F.round(span / F.nullif(n - 1, F.lit(0)) / 1000, 6).alias("budget_ms"))


def quarter_means(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Means of four consecutive chunks cut at round(i * n / 4), halves to even; empty chunks are left out."""
    placed = running_sum(rows.select(key, value, *order), key, order, F.lit(1), "__at").withColumn("__at", F.col("__at") - 1)
    # stored, so that Spark can split a key of many rows in the join
    counts = materialise(placed.groupBy(F.col(key).alias("__of")).agg((F.max("__at") + 1).alias("__n")), "counts")
    numbered = placed.join(counts, F.col(key).eqNullSafe(F.col("__of")))
    cut = lambda i: F.bround(F.col("__n") * i / 4, 0)
    quarter = F.when(F.col("__at") < cut(1), 1).when(F.col("__at") < cut(2), 2).when(F.col("__at") < cut(3), 3).otherwise(4)
    return numbered.groupBy(key, quarter.alias("quarter")).agg(F.round(F.avg(value), 6).alias("mean"))


def counterbalanced_delta(runs: DataFrame, key: str) -> DataFrame:
    """(c2 + c3) / (b1 + b4) - 1 and b4 / b1 - 1 of runs (key, run, value); null if any run is missing or not positive."""
    wide = runs.groupBy(key).pivot("run", ["b1", "c2", "c3", "b4"]).agg(F.avg("value"))
    valid = F.least(*[F.coalesce(F.col(c), F.lit(0.0)) for c in ("b1", "c2", "c3", "b4")]) > 0
    delta = (F.col("c2") + F.col("c3")) / (F.col("b1") + F.col("b4")) - 1
    return wide.select(key, F.round(F.when(valid, delta), 6).alias("delta"), F.round(F.when(valid, F.col("b4") / F.col("b1") - 1), 6).alias("spread"))


def best_worst(rows: DataFrame, key: str, value: str, label: Column) -> DataFrame:
    """Least and greatest value, where they were, and their spread; ties go to the lowest label."""
    return rows.groupBy(key).agg(
        F.min(value).alias("best"),
        F.max(value).alias("worst"),
        F.min_by(label, F.struct(F.col(value), label)).alias("best_at"),
        F.min_by(label, F.struct(-F.col(value), label)).alias("worst_at"),
        F.round(F.max(value) / F.nullif(F.min(value), F.lit(0.0)) - 1, 6).alias("spread"),
    )


def pass_range(rows: DataFrame, key: str, ms: str, frames: Column) -> DataFrame:
    """Passes, their total and extremes, milliseconds a frame and frames a second; null where a divisor is 0."""
    total, n = F.sum(ms), F.sum(frames)
    return rows.groupBy(key).agg(
        F.count("*").alias("passes"),
        F.round(total, 2).alias("total_ms"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
        F.round(total / F.nullif(n, F.lit(0)), 6).alias("ms_per_frame"),
        F.round(n * 1000 / F.nullif(total, F.lit(0.0)), 6).alias("fps"),
    )


def rate(rows: DataFrame, key: str, ns: Column, iterations: Column, sink: Column) -> DataFrame:
    """Nanoseconds an iteration, iterations a second and the exclusive or of the sinks."""
    total, n = F.sum(ns), F.sum(iterations)
    return rows.groupBy(key).agg(
        n.alias("iterations"), F.round(total / F.nullif(n, F.lit(0)), 6).alias("ns_per_iteration"), F.round(n * 1e9 / F.nullif(total, F.lit(0)), 6).alias("per_second"), F.bit_xor(sink).alias("sink")
    )


def lanes(rows: DataFrame, key: str, us: Column, ms: str) -> DataFrame:
    """Milliseconds a frame of each lane, and how many times faster than real time that is: the frame budget by it."""
    n = F.count("*")
    each = F.sum(ms) / n
    budget = (F.max(us) - F.min(us)) / F.nullif(n - 1, F.lit(0)) / 1000
    return rows.groupBy(key).agg(F.round(each, 6).alias("ms_per_frame"), F.round(budget / F.nullif(each, F.lit(0.0)), 4).alias("realtime"))
