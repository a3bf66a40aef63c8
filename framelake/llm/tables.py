"""Input tables of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import READ


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.options(**READ).parquet(f"{sf_dir}/{name}.parquet")


def free_names(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` without columns that begin like internal ones (two underscores), which get other names, and its own names in order."""
    names = docs.columns
    if not any(c.startswith("__") for c in names):
        return docs, names
    taken = {c.lower() for c in names}
    spare = (f"kept_{k}" for k in range(2 * len(names) + 1))
    free = (c for c in spare if c not in taken)
    return docs.toDF(*[next(free) if c.startswith("__") else c for c in names]), names
