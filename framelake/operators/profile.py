"""Attribution of profile samples to symbols by address ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan

BUCKET = 4096


def trailing(samples: DataFrame, time: str, span: int) -> DataFrame:
    """Samples of the last ``span`` units before the latest one."""
    latest = samples.agg(F.max(time).alias("__latest"))
    return samples.join(F.broadcast(latest)).filter(F.col(time) >= F.col("__latest") - span).drop("__latest")


def newest_range(samples: DataFrame, ranges: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(sample, symbol) of the range (start, end, symbol, rank) with the greatest rank that holds a sample's ip.

    Ranges are cut at multiples of a bucket, which makes the interval join an
    equal join.  The bucket is a power of two by length class, 64 pieces at most
    for each range, so one long mapping does not become many rows; a sample
    looks once into every class that occurs (their number is logarithmic).
    """
    length = (F.col("end") - F.col("start")).cast("double")
    level = F.greatest(F.ceil(F.log2(length / 32)), F.lit(int(bucket).bit_length() - 1)).cast("int")
    sized = ranges.filter("start < end").withColumn("__level", level)
    # levels are few (64 at most), whatever the ranges are
    levels = sized.select("__level").distinct()
    last = F.col("end") - 1
    pieces = sized.withColumn("__b", F.explode(F.sequence(_shifted("start"), _shifted(last)))).select("__level", "__b", "start", "end", "symbol", "rank")
    at = samples.select("sample", "ip").join(F.broadcast(levels)).withColumn("__b", _shifted("ip"))
    held = at.join(pieces, ["__level", "__b"]).filter((F.col("ip") >= F.col("start")) & (F.col("ip") < F.col("end")))
    return held.groupBy("sample").agg(F.max_by("symbol", F.struct("rank", "symbol")).alias("symbol"))


def _shifted(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value.cast("decimal(20,0)") / F.pow(F.lit(2.0), F.col("__level")).cast("decimal(20,0)")).cast("long")


def symbol_before(samples: DataFrame, ranges: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(sample, symbol) of the range with the greatest start not above a sample's ip, if it holds the ip.

    Only that one range is looked at: an outer range that also holds the ip does
    not count.  So each range ends for good where the next one starts; of ranges
    with the same start the last by ``order`` is taken.  The next start comes
    from a scan from the highest start down.
    """
    heads = ranges.groupBy("start").agg(F.max(F.struct("order", "end", "symbol")).alias("x")).select("start", "x.end", "x.symbol")
    nearest = scan.Step(F.min("start"), lambda w: F.min("start").over(w), lambda a, b: F.least(a, b))
    cut = scan.scan(heads, [], [F.desc("start")], nearest, "__next", inclusive=False)
    cut = cut.withColumn("end", F.least("end", F.coalesce("__next", "end")))
    return newest_range(samples, cut.select("start", "end", "symbol", F.col("start").alias("rank")), bucket)


def attribute(samples: DataFrame, jit: DataFrame, mmaps: DataFrame) -> DataFrame:
    """``samples`` with symbol: the nearest jit symbol below if it reaches so far, else the latest mapping, else ``<unmapped>``."""
    compiled = symbol_before(samples, jit).withColumnRenamed("symbol", "__jit")
    mapped = newest_range(samples, mmaps.withColumnRenamed("record", "rank")).withColumnRenamed("symbol", "__map")
    found = samples.join(compiled, "sample", "left").join(mapped, "sample", "left")
    return found.withColumn("symbol", F.coalesce("__jit", "__map", F.lit("<unmapped>"))).drop("__jit", "__map")


def histogram(samples: DataFrame, least_percent: float = 0.05) -> DataFrame:
    """Samples and periods of each symbol, in percent of all; rare ones are left out; heaviest first."""
    by = samples.groupBy("symbol").agg(F.count("*").alias("samples"), F.sum("period").alias("period"))
    total = by.agg(F.sum("period").alias("__total"))
    share = F.round(F.col("period") * 100.0 / F.col("__total"), 6)
    return by.join(F.broadcast(total)).withColumn("percent", share).filter(F.col("period") * 100.0 >= F.col("__total") * least_percent).drop("__total").orderBy(F.desc("period"), "symbol")
