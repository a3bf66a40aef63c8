"""Labelled rows for fitting: a bounded, reproducible sample that leaves the held-out fifth alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text falls into fold 0; a null id counts as empty text, which does."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, limits: dict[int, int]) -> DataFrame:
    """(text, label) of at most ``limits[value]`` rows for each label value, lowest id hash first.

    Null ids and null labels are left out, a doc_id with several labels counts
    with its largest, and a repeated doc_id gives one row.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .dropna()
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    chosen = None
    for value, limit in limits.items():
        some = known.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        chosen = some if chosen is None else chosen.unionByName(some)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label")).drop("doc_id")
