"""Packets from files that arrive in chunks, with Structured Streaming.

Chunks are rows (stream, seq, data, final): ``seq`` counts from 0 in each
stream and ``final`` marks the last one.  Wherever a file is cut, its packets
are those of the whole file.  A chunk that arrives before its predecessors
waits in the state; what follows damage or the end is ignored.

State is kept in three parts, so that a chunk costs in proportion to its own
bytes: a small value for the reader, a list of the bytes that it has not used,
which only grows by appending until the reader can go on, and a map of chunks
that came early.  Sessions need the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import logs, media
from ..sources.files import follow_log

_FIELDS = ["packet_index", "ts", "keyframe", "visible", "payload", "error"]
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Session:
    """A reader of one stream's chunks in order, without the bytes that wait for it.

    ``held`` counts those bytes; nothing can come of fewer than ``wanted``.
    """

    def __init__(self) -> None:
        self.reader, self.next, self.held, self.wanted, self.done = None, 0, 0, 4, False

    def feed(self, size: int, final: bool, load: Callable[[], bytes]) -> tuple[list[tuple], bytes | None]:
        """(packets, bytes that wait from now on, None if all there are go on waiting) for the next chunk of ``size`` bytes.

        ``load`` gives the waiting bytes, that chunk included; it is called only
        if something comes of them.
        """
        self.next += 1
        self.held += size
        if self.held < self.wanted and not final:
            return [], None
        data, out = load(), []
        try:
            if self.reader is None:
                make = media.READERS.get(data[:4])
                if make is None:
                    raise media.Damaged("neither IVF nor WebM")
                self.reader = make()
            out += [(*packet, None) for packet in self.reader.push(data)]
            if final:
                self.done = True
                self.reader.finish()
        except media.Damaged as why:
            self.done = True
            out.append((None, None, None, None, None, str(why)))
        if self.done:
            self.reader, self.held = None, 0
            return out, b""
        rest, self.reader.rest = bytes(self.reader.rest), bytearray()
        self.held, self.wanted = len(rest), self.reader.wanted
        return out, rest


class Demuxer(StatefulProcessor):
    """A stream's :class:`Session` in Spark's state.

    With ``patience``, a stream whose last chunk is there, but none of the
    chunks before it for so many milliseconds, ends with an error.
    """

    def __init__(self, stream: str, patience: int | None) -> None:
        self.stream, self.patience = stream, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "state binary, last long, timer long")
        self.bytes = handle.getListState("bytes", "data binary")
        self.early = handle.getMapState("early", "seq long", "data binary, final boolean")

    def _row(self, key: tuple, packet: tuple) -> Row:
        return Row(**{self.stream: key[0]}, **dict(zip(_FIELDS, packet)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.session.get() if self.session.exists() else None
        session, last, timer = (pickle.loads(held[0]), held[1], held[2]) if held else (Session(), None, None)
        fresh: dict[int, tuple[bytes, bool]] = {}
        for row in rows:
            if not session.done and row.seq >= session.next:
                fresh[int(row.seq)] = bytes(row.data), bool(row.final)
                last = int(row.seq) if row.final else last
        pending: list[bytes] = []
        replaced = False
        while not session.done:
            if session.next in fresh:
                data, final = fresh.pop(session.next)
            elif self.early.containsKey((session.next,)):
                data, final = self.early.getValue((session.next,))
                self.early.removeKey((session.next,))
            else:
                break
            pending.append(bytes(data))
            before = [] if replaced or not self.bytes.exists() else self.bytes.get()
            found, rest = session.feed(len(data), final, lambda before=before: b"".join([*(bytes(x[0]) for x in before), *pending]))
            if rest is not None:
                pending, replaced = [rest], True
            for packet in found:
                yield self._row(key, packet)
        if session.done:
            self._forget(timer)
            # what is left tells that later chunks are to be ignored
            self.session.update((pickle.dumps(session), None, None))
            return
        for seq, value in fresh.items():
            self.early.updateValue((seq,), value)
        kept = [(x,) for x in pending if x]
        if replaced:
            self.bytes.clear()
        if kept:
            self.bytes.appendList(kept)
        if self.patience is not None and last is not None and timer is None:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.patience
            self.handle.registerTimer(timer)
        self.session.update((pickle.dumps(session), last, timer))

    def _forget(self, timer: int | None) -> None:
        self.bytes.clear()
        self.early.clear()
        if timer is not None:
            self.handle.deleteTimer(timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, _, timer = self.session.get()
        session = pickle.loads(state)
        if not session.done and timer == expiredTimerInfo.getExpiryTimeInMs():
            yield self._row(key, (None, None, None, None, None, f"chunk {session.next} is missing"))
            session.done, session.reader, session.held = True, None, 0
            self.bytes.clear()
            self.early.clear()
            self.session.update((pickle.dumps(session), None, None))

    def close(self) -> None:
        pass


def packets(chunks: DataFrame, stream: str = "stream", patience: int | None = None) -> DataFrame:
    """(stream, packet fields, error) of streamed chunks; memory is bounded by a stream's unfinished element."""
    kind = chunks.schema[stream].dataType.simpleString()
    mode = "None" if patience is None else "ProcessingTime"
    return (
        chunks.select(stream, "seq", "data", "final")
        .groupBy(stream)
        .transformWithState(Demuxer(stream, patience), f"`{stream}` {kind}, {media.PACKET}", "Append", mode)
    )


def follow_events(spark: SparkSession, folder: str) -> DataFrame:
    """(path, at, raw, route) of JSON lines as the files of a folder grow; malformed ones are routed too."""
    lines = follow_log(spark, folder).withColumnRenamed("value", "raw")
    return lines.filter(F.trim("raw") != "").withColumn("route", logs.route(logs.parsed_json(F.col("raw"))))
