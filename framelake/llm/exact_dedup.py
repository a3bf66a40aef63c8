"""Exact deduplication by progressive refinement: length, head hash, full hash.

Texts are equal when they are identical after lower-casing A-Z only.  Rows are
grouped by length first; those whose length occurs once are done.  The others
are grouped by a hash of their first characters, and only rows that still share
both are read in full and hashed.  The surviving keys travel as a filter of
fixed size (:mod:`bitfilter`), so texts are not shuffled to find them; a false
survivor merely gets its full hash and turns out unique.

Of equal texts the row with the largest doc_id stays; a null doc_id is smaller
than any other, and of rows with the same doc_id exactly one stays.  Null texts
count as empty.  Rows are numbered by their place in the input's files.  An empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, numbered
from . import bitfilter
from .tables import free_names, read

HEAD = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z lower-cased; plain ASCII texts take the faster built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return numbered(docs).withColumns({"__text": text, "__length": F.octet_length(text).cast("long")})


def _length_key() -> Column:
    return F.xxhash64("__length")


def _head_key() -> Column:
    return F.xxhash64("__length", lowered(F.substring("__text", 1, HEAD)))


def survivors(docs: DataFrame) -> DataFrame:
    """``docs`` with __row, __text, __length and __survives: length and head are shared by another row, most likely."""
    keyed = _keyed(docs)
    lengths = bitfilter.build(keyed.groupBy("__length").count().filter("count > 1"), _length_key())
    by_length = bitfilter.test(keyed, _length_key(), lengths, "__survives")
    heads = by_length.filter("__survives").select(_head_key().alias("__head")).groupBy("__head").count().filter("count > 1")
    heads = bitfilter.build(heads, F.col("__head"))
    by_head = bitfilter.test(by_length, _head_key(), heads, "__shared")
    return by_head.withColumn("__survives", F.col("__survives") & F.col("__shared")).drop("__shared")


def decide(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: __row, doc_id, keep_id, group_size, kept, text_sha256.

    text_sha256 is null where no other row shares length and head, unless
    ``digest_all`` asks for it everywhere.
    """
    docs = numbered(docs)
    full = F.sha2(lowered(F.col("__text")), 256)
    digest = survivors(docs).select(
        "__row",
        F.col("doc_id").cast("long").alias("doc_id"),
        "__survives",
        (full if digest_all else F.when(F.col("__survives"), full)).alias("text_sha256"),
    )
    digest = materialise(digest, "digests")
    alone = digest.filter(~F.col("__survives")).select(
        "__row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    rows = digest.filter("__survives").drop("__survives")
    # stored, so that both sides of the join are shuffled for it alone: Spark then splits a group that fills a task
    groups = rows.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "__row")).alias("__best"), F.count("*").alias("group_size")
    )
    groups = materialise(groups, "groups")
    shared = rows.join(groups, "text_sha256").select(
        "__row",
        "doc_id",
        F.col("__best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("__row") == F.col("__best.__row")).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(shared)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only rows that share length and head with another are joined with the
    decisions; all others pass where they are.
    """
    docs, names = free_names(docs)
    columns, docs = docs.columns, numbered(docs)
    dropped = materialise(decide(docs).filter(~F.col("kept")).select("__row"), "dropped")
    marked = survivors(docs)
    rest = marked.filter("__survives").join(dropped, "__row", "left_anti")
    return marked.filter(~F.col("__survives")).select(columns).union(rest.select(columns)).toDF(*names)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(read(spark, sf_dir, "documents"), digest_all=True).drop("__row")


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d
"""
