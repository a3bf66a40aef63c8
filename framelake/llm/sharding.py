"""Sharding over fixed virtual slots with a stored, versioned slot-to-shard map.

Every record is hashed into one of ``slots`` virtual slots.  Bytes are added up
for each slot, and the slot-to-shard map decides the rest: version 0 deals
slots round robin, and each rebalancing writes a further version in which only
as many slots move as are needed to bring the shards to equal bytes.  Versions
are kept under a path of the user's (:class:`SlotMaps`), where they can be
loaded, edited and added to.  The law
is ``bytes``: sizes near equal.

A slot that outweighs a quarter of a shard (at most ``4 * shards`` slots can) is
divided into ``parts`` cells by row number, so a repeated key or one text that
fills a third of the table still spreads.  The map has at most
``slots + 4 * shards * parts`` rows, whatever the input.

Defined results: a null text has no bytes and the checksum of an empty one; a
null doc_id is a value like any other; repeated rows are placed one by one; an
empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise, shared_dir
from .tables import read

SHARDS = 24
SLOTS = 8192
PARTS = 256
OVERHEAD = 8


def digests(docs: DataFrame, slots: int = SLOTS, parts: int = PARTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, virtual slot and part of each record, stored; ``carry`` names columns to keep."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64("doc_id", text), F.lit(slots)).cast("int").alias("virtual_slot"),
            F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int").alias("__part"),
            *carry,
        ),
        "digests",
    )


def cells(records: DataFrame, shards: int = SHARDS, slots: int = SLOTS, parts: int = PARTS) -> DataFrame:
    """``records`` with ``cell``: the virtual slot, or one of its parts where the slot is heavy."""
    by_slot = records.groupBy("virtual_slot").agg(F.sum("size").alias("__bytes"))
    total = by_slot.agg(F.sum("__bytes").alias("__total"))
    heavy = by_slot.join(F.broadcast(total)).filter(F.col("__bytes") * 4 * shards > F.col("__total")).select("virtual_slot", F.lit(True).alias("__heavy"))
    divided = F.lit(slots) + F.col("virtual_slot") * parts + F.col("__part")
    return records.join(F.broadcast(heavy), "virtual_slot", "left").withColumn("cell", F.when(F.col("__heavy"), divided).otherwise(F.col("virtual_slot"))).drop("__heavy")


def first_map(placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 0: every cell that holds records, dealt round robin, with its rows and bytes."""
    held = placed.groupBy("cell").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    return held.select(F.lit(0).alias("version"), "cell", F.pmod("cell", F.lit(shards)).cast("int").alias("shard"), "rows", "bytes")


def rebalance(current: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The map's next version: shards keep their largest cells up to an equal share; the rest go, largest first, to whichever shard has least."""
    share = current.agg(F.ceil(F.sum("bytes") / F.lit(shards)).alias("__share"))
    running = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.desc("bytes"), "cell").rowsBetween(W.unboundedPreceding, 0))
    ranked = current.join(F.broadcast(share)).withColumn("__stays", running <= F.col("__share"))
    loads = ranked.filter("__stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    loads = current.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(loads, "shard", "left")
    start = loads.agg(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0).cast("long")).alias("load")))).alias("__loads"))
    moving = ranked.filter(~F.col("__stays")).agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "cell"))).alias("__cells"))
    dealt = start.join(F.broadcast(moving)).select(
        F.explode(
            F.expr("""
              aggregate(
                __cells,
                struct(transform(__loads, x -> x.load) AS loads, cast(array() AS array<struct<cell: int, shard: int>>) AS put),
                (state, c) -> struct(
                  transform(state.loads, (x, i) -> if(i = array_position(state.loads, array_min(state.loads)) - 1, x - c.less, x)) AS loads,
                  array_append(state.put, struct(c.cell AS cell, cast(array_position(state.loads, array_min(state.loads)) - 1 AS int) AS shard)) AS put
                ),
                state -> state.put
              )""")
        ).alias("__put")
    )
    moved = dealt.select(F.col("__put.cell").alias("cell"), F.col("__put.shard").alias("__to"))
    return ranked.join(moved, "cell", "left").select(
        (F.col("version") + 1).alias("version"), "cell", F.coalesce("__to", "shard").alias("shard"), "rows", "bytes"
    )


class SlotMaps:
    """The versions of a map in a shared folder, one subfolder each; a version is written once and never changed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version:06d}"

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        names = [status.getPath().getName() for status in files.listStatus(path)]
        # a version without its mark was not written to its end
        whole = lambda name: files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS"))
        return sorted(int(name.removeprefix("version=")) for name in names if name.startswith("version=") and whole(name))

    def load(self, version: int | None = None) -> DataFrame:
        """A version of the map, the latest if none is named."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"no version {'at all' if version is None else version} in {self.path}")
        version = known[-1] if version is None else version
        return self.spark.read.parquet(self._folder(version)).withColumn("version", F.lit(version))

    def add(self, slot_map: DataFrame) -> DataFrame:
        """Store ``slot_map`` as the next version, and read it back."""
        version = next(iter(self.versions()[-1:]), -1) + 1
        slot_map.drop("version").write.parquet(self._folder(version))
        return self.load(version)

    def edit(self, moves: DataFrame) -> DataFrame:
        """The latest version with the cells of ``moves`` (cell, shard) moved, as the next one; other cells stay."""
        moved = moves.select("cell", F.col("shard").cast("int").alias("__to"))
        latest = self.load().join(F.broadcast(moved), "cell", "left")
        return self.add(latest.withColumn("shard", F.coalesce("__to", "shard")).drop("__to"))


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and gapless slot of each record.

    A cell's records are numbered on their own; where a cell begins in its
    shard comes from the map, so no task sees a whole shard.
    """
    before = F.sum("rows").over(W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    starts = slot_map.select("cell", "shard", F.col("version").alias("map_version"), F.coalesce(before, F.lit(0)).alias("__start"))
    within = F.row_number().over(W.partitionBy("cell").orderBy("doc_id", "text_crc32", "size", "__part"))
    return records.join(F.broadcast(starts), "cell").withColumn("slot", F.col("__start") + within - 1).drop("__start", "__part")


def shard_documents(docs: DataFrame, maps: SlotMaps, shards: int = SHARDS, slots: int = SLOTS, parts: int = PARTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Placed records; the map they follow is the latest of ``maps``, rebalanced from the one before.

    Cells that the latest stored version does not know start on the shard that
    round robin gives them; what it knows stays where it is until rebalancing
    moves it, so records that come again keep their shards for the most part.
    """
    placed = cells(digests(docs, slots, parts, carry), shards, slots, parts)
    held = first_map(placed, shards)
    if maps.versions():
        known = maps.load().select("cell", F.col("shard").alias("__kept"))
        held = held.join(F.broadcast(known), "cell", "left").withColumn("shard", F.coalesce("__kept", "shard")).drop("__kept")
    base = maps.add(held)
    return place(placed, maps.add(rebalance(base, shards)))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each run of this query starts its maps anew; a user names a folder that stays
    maps = SlotMaps(spark, f"{shared_dir(spark)}/framelake/slot-maps-{uuid.uuid4().hex}")
    placed = shard_documents(read(spark, sf_dir, "documents"), maps)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )
