"""Ordered folds: groups of pictures, ordinals, slots, rings, carried values."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise
from . import scan

#: Fixed value: beyond any time in ms.
_FAR = 1 << 62


def running_sum(rows: DataFrame, stream: str, order: list[str | Column], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` in their stream up to and with each row; see :func:`scan.scan`."""
    rows = rows.withColumn("__value", value.cast("long"))
    return scan.scan(rows, [stream], order, scan.total(F.col("__value")), name).drop("__value")


def gop_ids(packets: DataFrame, stream: str, order: list[str], keyframe: Column) -> DataFrame:
    """``packets`` with gop: key frames so far; 0 before the first one."""
    return running_sum(packets, stream, order, keyframe, "gop")


def visible_ordinals(packets: DataFrame, stream: str, order: list[str], visible: Column) -> DataFrame:
    """``packets`` with ordinal: the place among visible ones from 0, null for those that are known not to be."""
    counted = running_sum(packets.withColumn("__visible", F.coalesce(visible, F.lit(True))), stream, order, F.col("__visible"), "ordinal")
    return counted.withColumn("ordinal", F.when(F.col("__visible"), F.col("ordinal") - 1)).drop("__visible")


def output_window(outputs: DataFrame, offset: int, n: int) -> DataFrame:
    """Outputs ``offset`` to ``offset + n - 1`` of each stream."""
    return outputs.filter((F.col("ordinal") >= offset) & (F.col("ordinal") < offset + n))


def keyframe_start(packets: DataFrame, stream: str, index: str, order: list[str], visible: Column, keyframe: Column, offset: int) -> DataFrame:
    """Where to start so that the first output is visible packet ``offset``: it must be a key frame, but for the very first.

    Offset 0 starts a stream at its first packet, whatever that is.
    """
    if offset == 0:
        first = packets.groupBy(stream).agg(F.min_by(index, F.struct(*order)).alias("start"))
        return first.select(stream, F.lit("ok").alias("status"), "start")
    numbered = visible_ordinals(packets.withColumn("__key", keyframe), stream, order, visible)
    at = numbered.filter(F.col("ordinal") == offset).select(stream, F.col(index).alias("start"), "__key")
    streams = packets.select(stream).distinct()
    status = F.when(F.col("start").isNull(), "too_short").when(F.col("__key"), "ok").otherwise("not_keyframe")
    return streams.join(at, stream, "left").select(stream, status.alias("status"), F.when(F.col("__key"), F.col("start")).alias("start"))


def slot_lineage(frames: DataFrame, stream: str, order: list[str], frame: str, flags: Column, slot: Column, slots: int = 8) -> DataFrame:
    """``frames`` with source: the latest earlier frame that refreshed the slot which each one reads."""
    held = [F.when(F.shiftright(flags, i).bitwiseAND(F.lit(1)) == 1, F.col(frame)) for i in range(slots)]
    found = scan.scan(frames, [stream], order, scan.latest_each(held, order), "__slots", inclusive=False)
    return found.withColumn("source", F.element_at("__slots", (slot + 1).cast("int"))).drop("__slots")


def last_record(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The value of the last record of each key."""
    return rows.groupBy(*key).agg(F.max_by(value, order).alias(value))


def ring(rows: DataFrame, key: str, order: list[Column], size: int = 240) -> DataFrame:
    """The last ``size`` rows of each key; ``order`` is descending."""
    return running_sum(rows, key, order, F.lit(1), "__n").filter(F.col("__n") <= size).drop("__n")


def peak(rows: DataFrame, key: str, ratio: Column, order: str) -> DataFrame:
    """The row of each key with the greatest ratio; the first of equals."""
    whole = F.struct(*rows.columns, ratio.alias("ratio"))
    best = F.min_by(whole, F.struct((-ratio).isNull().alias("none"), (-ratio).alias("least"), F.col(order).alias("place")))
    return rows.groupBy(key).agg(best.alias("__row")).select("__row.*")


def carried(rows: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the latest non-null value so far, as a section header holds for the lines below it."""
    return scan.scan(rows, [key], order, scan.latest(value, order), name)


def every(rows: DataFrame, index: str, n: int) -> DataFrame:
    """Rows at multiples of ``n``: progress reports."""
    return rows.filter((F.col(index) > 0) & (F.col(index) % n == 0))


def first_packets(packets: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` packets; Spark keeps ``n`` of each task and no more."""
    return packets.orderBy(*order).limit(n)


def newest_first(files: DataFrame, time: str, path: str, n: int) -> DataFrame:
    """The ``n`` newest files with their place from 1; of equal times the lesser path comes first."""
    top = files.orderBy(F.desc(time), path).limit(n)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc(time), path)))


def _fold(packets: Iterable[tuple], longest: int, state: tuple | None) -> Iterator[tuple]:
    """(start, cluster) after each (ms, key) packet; ``state`` is that of the packet before, None at the start of a stream."""
    for ms, key in packets:
        if state is None:
            state = ms, 0
        elif key or (ms is not None and state[0] is not None and (ms - state[0] > longest or ms < state[0])):
            state = ms, state[1] + 1
        yield state


def _steps(packets: Iterable[tuple], longest: int) -> list[tuple]:
    """(low, same, start, opened) by low: where a run of packets ends, for every start from ``low`` on with which it may begin.

    All starts are followed at once: those that open a cluster at the same packet
    are one from then on, and open ones lie between the oldest and the newest.
    """
    low, high = -_FAR, _FAR  # starts that have opened nothing yet
    groups: deque = deque()  # [start, parts] by start; a part is a group or an interval
    for ms, key in packets:
        parts: list = []
        if key:
            parts += [(low, high)] if low <= high else []
            parts += groups
            low, high = 1, 0
            groups.clear()
        elif ms is not None:
            if low <= high and low < ms - longest:
                parts.append((low, min(high, ms - longest - 1)))
                low = ms - longest
            if low <= high and high > ms:
                parts.append((max(low, ms + 1), high))
                high = ms
            while groups and groups[0][0] is not None and groups[0][0] < ms - longest:
                parts.append(groups.popleft())
            while groups and groups[-1][0] is not None and groups[-1][0] > ms:
                parts.append(groups.pop())
        if parts and groups and groups[-1][0] == ms:
            groups[-1][1].extend(parts)
        elif parts:
            groups.append([ms, parts])
    out = [(low, True, None, 0)] if low <= high else []
    for start, parts in groups:
        open_parts = [(part, 1) for part in parts]
        while open_parts:
            part, opened = open_parts.pop()
            if isinstance(part, list):
                open_parts += [(x, opened + 1) for x in part[1]]
            else:
                out.append((part[0], False, start, opened))
    out.sort(key=lambda x: x[0])
    return [x for k, x in enumerate(out) if not k or x[1:] != out[k - 1][1:]]


def mux_clusters(packets: DataFrame, stream: str, index: str, ms: str, keyframe: str, longest: int = 30_000, chunk: int = 100_000) -> DataFrame:
    """(stream, index, cluster): a cluster opens at the first packet, at a key frame, ``longest`` ms after its start, or when time runs back.

    Where a cluster starts decides when the next one does.  Packets are dealt in
    order into ranges of about ``chunk`` rows, however many one stream has; each
    range within one stream tells where it ends for every start it may be given,
    the driver chains these, one range after another as they stream by, and then
    all ranges are numbered at once.
    """
    spark = packets.sparkSession
    rows = packets.select(F.col(stream).alias("stream"), F.col(index).alias("i"), F.col(ms).cast("long").alias("ms"), F.col(keyframe).alias("key"))
    ranges = -(-rows.count() // chunk) or 1
    order = ["stream", "i", "ms", "key"]
    dealt = materialise(rows.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "packets")
    kinds = {field.name: field.dataType.simpleString() for field in dealt.schema}

    def streams(table: pa.Table) -> list[tuple]:
        """(stream, its packets) in order."""
        found = sorted(zip(*(table.column(name).to_pylist() for name in order)), key=lambda row: [(x is not None, x) for x in row])
        return [(k, list(x)) for k, x in groupby(found, key=lambda row: row[0])]

    def summary(key: tuple, table: pa.Table) -> pa.Table:
        parts = streams(table)
        timed = [(row[2], row[3]) for row in parts[-1][1]]
        fresh, unknown = (deque(_fold(timed, longest, state), 1)[0] for state in (None, (None, 0)))
        steps = [dict(zip(("low", "same", "start", "opened"), x)) for x in _steps(timed, longest)] if len(parts) == 1 else []
        out = {"__range": key[0].as_py(), "first": parts[0][0], "last": parts[-1][0], "whole": len(parts) == 1, "start": fresh[0], "n": fresh[1], "none_start": unknown[0], "none_n": unknown[1], "steps": steps}
        kind = table.schema.field("stream").type
        step = pa.list_(pa.struct([("low", pa.int64()), ("same", pa.bool_()), ("start", pa.int64()), ("opened", pa.int64())]))
        schema = [("__range", pa.int32()), ("first", kind), ("last", kind), ("whole", pa.bool_()), *((x, pa.int64()) for x in ("start", "n", "none_start", "none_n")), ("steps", step)]
        return pa.Table.from_pylist([out], pa.schema(schema))

    schema = f"__range int, first {kinds['stream']}, last {kinds['stream']}, whole boolean, start long, n long, none_start long, none_n long, steps array<struct<low: bigint, same: boolean, start: bigint, opened: bigint>>"
    entries: dict[int, tuple] = {}
    before = None
    told = materialise(dealt.groupBy("__range").applyInArrow(summary, schema), "ends")
    for r in told.orderBy("__range").toLocalIterator():
        state = r.start, r.n
        if before is not None and before[0] == r.first:
            start, n = entries[r["__range"]] = before[1]
            if r.whole and start is None:
                state = r.none_start, n + r.none_n
            elif r.whole:
                step = r.steps[bisect_right(r.steps, start, key=lambda x: x.low) - 1]
                state = start if step.same else step.start, n + step.opened
        before = r.last, state
    shared = spark.sparkContext.broadcast(entries)

    def clusters(key: tuple, table: pa.Table) -> pa.Table:
        state, out = shared.value.get(key[0].as_py()), []
        for name, part in streams(table):
            out += [(name, row[1], n) for row, (_, n) in zip(part, _fold([row[2:] for row in part], longest, state))]
            state = None
        columns = list(zip(*out))
        kind = [table.schema.field("stream").type, table.schema.field("i").type, pa.int64()]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, kind)], ["stream", "i", "cluster"])

    found = dealt.groupBy("__range").applyInArrow(clusters, f"stream {kinds['stream']}, i {kinds['i']}, cluster long")
    return found.select(F.col("stream").alias(stream), F.col("i").alias(index), "cluster")
