"""Positional comparison of decoded frames with golden ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import running_sum


def number(rows: DataFrame, stream: str, order: str, name: str = "frame") -> DataFrame:
    """Ordinal of each row in its stream, from 0; a long stream spreads over many tasks."""
    return running_sum(rows, stream, [order], F.lit(1), name).withColumn(name, F.col(name) - 1)


def compare(actual: DataFrame, golden: DataFrame) -> DataFrame:
    """Full outer join of (stream, frame, digest) by place, not by name."""
    a, g = actual.withColumnRenamed("digest", "actual"), golden.withColumnRenamed("digest", "expected")
    return a.join(g, ["stream", "frame"], "full_outer")


def summarise(compared: DataFrame) -> DataFrame:
    """Counts for each stream; a frame without a counterpart is extra or missing, not a mismatch."""
    both = F.col("actual").isNotNull() & F.col("expected").isNotNull()
    return compared.groupBy("stream").agg(
        F.count("expected").alias("expected_frames"),
        F.count("actual").alias("actual_frames"),
        F.count_if(both & (F.col("actual") == F.col("expected"))).alias("matched"),
        F.count_if(both & (F.col("actual") != F.col("expected"))).alias("mismatched"),
        F.greatest(F.count("expected") - F.count("actual"), F.lit(0)).alias("missing"),
        F.greatest(F.count("actual") - F.count("expected"), F.lit(0)).alias("extra"),
    )


def first_mismatches(compared: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` frames whose digests differ; frames that exist on the decoded side only count too."""
    differs = ~F.col("actual").eqNullSafe(F.col("expected")) & F.col("actual").isNotNull()
    return compared.filter(differs).orderBy("stream", "frame").limit(n)
