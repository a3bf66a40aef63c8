"""Ordered scans of streams by any associative step, over ranges of rows instead of whole streams.

A window over one stream runs in one task.  Here rows are dealt in order into
ranges, whatever stream they are of, so a stream that holds a third of all rows
spreads over a third of the tasks.  Each range sums up its rows of each stream;
a tree whose groups have ``FAN`` members combines these summaries, so that
each range knows with what its streams reach it; and each row combines that
with what stands before it in its own range.

Every step takes null for nothing yet.  Rows of equal order count in any order,
as in a window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise

#: Summaries that one group of the tree combines.
FAN = 64


@dataclass(frozen=True)
class Step:
    """What is carried along a stream.

    ``summary`` aggregates the rows of a group, ``running`` does so for those of
    a window, and ``combine`` puts an earlier and a later one together; neither
    of its arguments is null.
    """

    summary: Column
    running: Callable[[WindowSpec], Column]
    combine: Callable[[Column, Column], Column]

    def both(self, before: Column, after: Column) -> Column:
        return F.when(before.isNull(), after).when(after.isNull(), before).otherwise(self.combine(before, after))


def total(value: Column) -> Step:
    """The sum so far."""
    return Step(F.sum(value), lambda w: F.sum(value).over(w), lambda a, b: a + b)


def latest(value: Column, order: list[str]) -> Step:
    """The last value so far that is not null."""
    known = F.when(value.isNotNull(), F.struct(*order))
    return Step(F.max_by(value, known), lambda w: F.last(value, ignorenulls=True).over(w), lambda a, b: b)


def latest_each(values: list[Column], order: list[str]) -> Step:
    """An array of the last value of each kind that is not null."""
    steps = [latest(value, order) for value in values]
    return Step(
        F.array(*[s.summary for s in steps]),
        lambda w: F.array(*[s.running(w) for s in steps]),
        lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(y, x)),
    )


def _before(parts: DataFrame, keys: list[str], step: Step, ranges: int) -> DataFrame:
    """(keys, __range, __start): what the ranges before each one amount to; ``parts`` has (keys, __range, __sum)."""
    earlier = W.partitionBy(*keys, "__group").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)

    def within(rows: DataFrame) -> DataFrame:
        # FAN summaries at most, so folding them for each takes bounded time
        states = F.collect_list(F.struct(F.col("__sum").alias("v"))).over(earlier)
        whole = F.aggregate(F.slice(states, F.lit(2), F.size(states)), states[0]["v"], lambda a, x: step.both(a, x["v"]))
        return rows.withColumn("__group", F.floor(F.col("__range") / FAN).cast("int")).withColumn("__states", states).withColumn("__start", F.when(F.size("__states") > 0, whole))

    local = within(parts)
    if ranges <= FAN:
        return local.select(*keys, "__range", "__start")
    last = F.max_by(F.struct(step.both(F.col("__start"), F.col("__sum")).alias("v")), "__range")["v"]
    groups = materialise(local.groupBy(*keys, "__group").agg(last.alias("__sum")).withColumnRenamed("__group", "__range"), "groups")
    above = _before(groups, keys, step, -(-ranges // FAN)).select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__range").alias("__block"), F.col("__start").alias("__above"))
    same = F.col("__group") == F.col("__block")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return local.join(above, same, "left").select(*keys, "__range", step.both(F.col("__above"), F.col("__start")).alias("__start"))


def scan(rows: DataFrame, keys: list[str], order: list[str | Column], step: Step, name: str, inclusive: bool = True, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``name``: what their stream's rows up to each one amount to, or with ``inclusive`` off those before it.

    ``keys`` name a stream and may be null.  All columns of ``rows`` are stored
    on the way: leave out what is not needed.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    number = [] if ranges is None else [ranges]
    kept = [c for c in rows.columns if c != name]
    dealt = materialise(rows.repartitionByRange(*number, *keys, *columns).withColumn("__range", F.spark_partition_id()), "ranges")
    count = (dealt.agg(F.max("__range")).first()[0] or 0) + 1
    starts = _before(materialise(dealt.groupBy(*keys, "__range").agg(step.summary.alias("__sum")), "sums"), keys, step, count)
    starts = starts.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__range").alias("__in"), "__start")
    window = W.partitionBy(*keys, "__range").orderBy(*columns).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    same = F.col("__range") == F.col("__in")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    placed = dealt.withColumn("__at", step.running(window)).join(starts, same)
    return placed.select(*kept, step.both(F.col("__start"), F.col("__at")).alias(name))
