"""Packets of IVF and WebM files, superframes, and a WebM writer.

A file is a row (stream, content).  Walking a container is sequential within a
file, so files are the unit of parallelism: readers are ``mapInArrow`` over
``binaryFile``-like tables and yield packets as they find them.  A damaged file
gives one row with ``error`` after the packets before the damage; no job ends
because of it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.cursor import bind

PACKET = "packet_index long, ts long, keyframe boolean, visible boolean, payload binary, error string"
HEADER = "container string, width long, height long, tb_num long, tb_den long, declared_frames long, timestamp_scale long"

#: Element identifiers.
EBML, DOC_TYPE, SEGMENT, INFO, SCALE = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK, NUMBER, TYPE, CODEC, VIDEO, WIDTH, HEIGHT = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0xE0, 0xB0, 0xBA
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB


def container(content: Column) -> Column:
    """``ivf``, ``webm`` or null, by the first four bytes."""
    head = bits.hex_at(content, 0, 4)
    return F.when(head == "444B4946", "ivf").when(head == "1A45DFA3", "webm")


class Damaged(ValueError):
    """What is wrong with a file."""


class Starved(Exception):
    """More bytes are needed."""


class Ivf:
    """IVF packets from bytes that come in chunks; any chunking gives the same packets.

    ``rest`` holds the bytes that are not used yet, and nothing can come of
    fewer than ``wanted`` of them.
    """

    def __init__(self) -> None:
        self.header: dict | None = None
        self.rest, self.skip, self.n, self.wanted = bytearray(), 0, 0, 32

    def push(self, chunk: bytes) -> Iterator[tuple]:
        self.rest += chunk
        data, at = self.rest, 0
        if self.header is None and len(data) >= 32:
            mark, version, length, codec, width, height, den, num, frames = struct.unpack_from("<4sHH4sHHIII", data)
            if mark != b"DKIF" or version or length < 32 or codec != b"VP90":
                raise Damaged("bad IVF header")
            self.header = {"container": "ivf", "width": width, "height": height, "tb_num": num, "tb_den": den, "declared_frames": frames, "timestamp_scale": None}
            at, self.skip = 32, length - 32
        if self.header is not None:
            step = min(self.skip, len(data) - at)
            at, self.skip = at + step, self.skip - step
            while not self.skip and len(data) - at >= 12:
                size, ts = struct.unpack_from("<IQ", data, at)
                if len(data) - at - 12 < size:
                    break
                yield self.n, ts if ts < 1 << 63 else ts - (1 << 64), None, None, bytes(data[at + 12 : at + 12 + size])
                at, self.n = at + 12 + size, self.n + 1
        del data[:at]
        if self.header is not None:
            self.wanted = 1 if self.skip else 12 if len(data) < 12 else 12 + int.from_bytes(data[:4], "little")

    def finish(self) -> Iterator[tuple]:
        if self.header is None or self.skip:
            raise Damaged("truncated IVF header")
        if self.rest:
            raise Damaged(f"packet {self.n} is truncated")
        if not self.n:
            raise Damaged("no packets")
        return iter(())


def read_vint(data: bytes, at: int, identifier: bool = False, end: int | None = None) -> tuple[int | None, int]:
    """(value, place after it) from what stands before ``end``; an unknown size is None."""
    end = len(data) if end is None else end
    if at >= end:
        raise Starved
    first = data[at]
    width = 9 - first.bit_length()
    if not first or (identifier and width > 4):
        raise Damaged("bad variable-length integer")
    if at + width > end:
        raise Starved
    value = int.from_bytes(data[at : at + width], "big")
    if not identifier:
        value -= 1 << 7 * width
        if value == (1 << 7 * width) - 1:
            return None, at + width
    return value, at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(identifier, begin, end) of the elements between two places; they must fit."""
    while at < end:
        try:
            name, at = read_vint(data, at, True)
            size, at = read_vint(data, at)
        except Starved:
            raise Damaged("element exceeds its parent") from None
        if size is None or at + size > end:
            raise Damaged("element exceeds its parent")
        yield name, at, at + size
        at += size


class Webm:
    """Packets of the one video track of a WebM file from bytes that come in chunks.

    Only headers, tracks and one cluster at a time are held; other elements are
    passed over as they come.  ``rest`` holds the bytes that are not used yet,
    and nothing can come of fewer than ``wanted`` of them.
    """

    KEPT = (EBML, INFO, TRACKS, CLUSTER)

    def __init__(self) -> None:
        self.header: dict | None = None
        self.rest, self.skip, self.n, self.wanted = bytearray(), 0, 0, 1
        self.inside, self.left = False, None
        self.scale, self.tracks, self.track = 1_000_000, [], None

    def _uint(self, data: bytes, a: int, b: int) -> int:
        value = int.from_bytes(data[a:b], "big")
        if b - a > 8 or value >= 1 << 53:
            raise Damaged("integer is too wide")
        return value

    def _describe(self) -> None:
        chosen = [t for t in self.tracks if t.get(TYPE) == 1 and t.get(CODEC) == b"V_VP9"]
        if len(chosen) != 1 or not all(chosen[0].get(k) for k in (NUMBER, WIDTH, HEIGHT)) or not self.scale:
            raise Damaged("not exactly one complete video track")
        self.track = chosen[0][NUMBER]
        self.header = {"container": "webm", "width": chosen[0][WIDTH], "height": chosen[0][HEIGHT], "tb_num": None, "tb_den": None, "declared_frames": None, "timestamp_scale": self.scale}

    def _fields(self, data: bytes, a: int, b: int) -> dict:
        out: dict = {}
        for name, x, y in elements(data, a, b):
            if name == VIDEO:
                out |= self._fields(data, x, y)
            elif name == CODEC:
                out[name] = data[x:y]
            elif name in (NUMBER, TYPE, WIDTH, HEIGHT):
                out[name] = self._uint(data, x, y)
        return out

    def _block(self, data: bytes, a: int, b: int, base: int, key: bool | None) -> Iterator[tuple]:
        try:
            track, at = read_vint(data, a, end=b)
        except Starved:
            raise Damaged("truncated block") from None
        if at + 3 > b:
            raise Damaged("truncated block")
        relative, flags = struct.unpack_from(">hB", data, at)
        if track != self.track:
            return
        if flags & 6:
            raise Damaged("laced block")
        yield self.n, base + relative, bool(flags & 0x80) if key is None else key, not flags & 8, bytes(data[at + 3 : b])
        self.n += 1

    def _cluster(self, data: bytes, a: int, b: int) -> Iterator[tuple]:
        inner = list(elements(data, a, b))
        base = next((self._uint(data, x, y) for name, x, y in reversed(inner) if name == TIMESTAMP), 0)
        for name, x, y in inner:
            if name == SIMPLE:
                yield from self._block(data, x, y, base, None)
            elif name == GROUP:
                parts = list(elements(data, x, y))
                alone = all(part[0] != REFERENCE for part in parts)
                for part, u, v in parts:
                    if part == BLOCK:
                        yield from self._block(data, u, v, base, alone)

    def _take(self, name: int, data: bytes, a: int, b: int) -> Iterator[tuple]:
        if name == EBML:
            if any(data[x:y] != b"webm" for part, x, y in elements(data, a, b) if part == DOC_TYPE):
                raise Damaged("not WebM")
        elif name == INFO:
            self.scale = next((self._uint(data, x, y) for part, x, y in reversed(list(elements(data, a, b))) if part == SCALE), self.scale)
        elif name == TRACKS:
            self.tracks += [self._fields(data, x, y) for part, x, y in elements(data, a, b) if part == TRACK]
        else:
            if self.header is None:
                self._describe()
            yield from self._cluster(data, a, b)

    def push(self, chunk: bytes) -> Iterator[tuple]:
        self.rest += chunk
        data, at = self.rest, 0
        self.wanted = 1
        try:
            while True:
                step = min(self.skip, len(data) - at)
                at, self.skip = at + step, self.skip - step
                if self.left is not None:
                    self.left -= step
                    if self.left <= 0:
                        self.inside, self.left = False, None
                if self.skip or at >= len(data):
                    break
                name, begin = read_vint(data, at, True)
                size, begin = read_vint(data, begin)
                if name == SEGMENT and not self.inside:
                    at, self.inside, self.left = begin, True, size
                    continue
                if size is None:
                    raise Damaged("unknown size")
                if self.left is not None and begin - at + size > self.left:
                    raise Damaged("element exceeds its parent")
                if name in self.KEPT and (self.inside or name == EBML):
                    if begin + size > len(data):
                        self.wanted = begin + size - at
                        break
                    yield from self._take(name, data, begin, begin + size)
                # its body and head are passed over like any other's
                self.skip = begin - at + size
        except Starved:
            self.wanted = len(data) - at + 1
        del data[:at]

    def finish(self) -> Iterator[tuple]:
        if self.rest or self.skip:
            raise Damaged("truncated element")
        if self.header is None:
            self._describe()
        if not self.n:
            raise Damaged("no packets")
        return iter(())


READERS: dict[bytes, Callable[[], Ivf | Webm]] = {b"DKIF": Ivf, b"\x1aE\xdf\xa3": Webm}


def parse(content: bytes) -> Iterator[tuple[dict | None, tuple]]:
    """(header, (packet index, ts, keyframe, visible, payload, error)) of a whole file."""
    reader = READERS.get(content[:4])
    if reader is None:
        yield None, (None, None, None, None, None, "neither IVF nor WebM")
        return
    reader = reader()
    try:
        for packet in reader.push(content):
            yield reader.header, (*packet, None)
        reader.finish()
    except Damaged as why:
        yield reader.header, (None, None, None, None, None, str(why))


_NAMES = [part.split()[0] for part in f"{HEADER}, {PACKET}".split(", ")]
_NOTHING = dict.fromkeys(_NAMES[:7])


def packet_batches(found: Iterable[tuple], stream: str, kind: pa.DataType, most_rows: int = 2000, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of (stream, header, packet), filled across files."""
    types = [kind, pa.string(), *[pa.int64()] * 6, pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.string()]
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [stream, *_NAMES])
    rows, size = [], 0
    for name, header, packet in found:
        rows.append((name, *(header or _NOTHING).values(), *packet))
        size += len(packet[4] or b"")
        if size > most_bytes or len(rows) >= most_rows:
            yield make(rows)
            rows, size = [], 0
    if rows:
        yield make(rows)


def packets(files: DataFrame, stream: str = "stream", content: str = "content") -> DataFrame:
    """(stream, header fields, packet fields, error) of every file of ``files``.

    A null content counts as empty bytes.  Empty tables give no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((name.as_py(), header, packet) for name, data in zip(batch.column(0), batch.column(1)) for header, packet in parse(data.as_py() or b""))
            yield from packet_batches(rows, stream, batch.schema.field(0).type)

    kind = files.schema[stream].dataType.simpleString()
    return files.select(stream, F.col(content).cast("binary")).mapInArrow(scan, f"`{stream}` {kind}, {HEADER}, {PACKET}")


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets of the media files under ``path`` (a folder, a file or a pattern), by the file's path as stream."""
    files = spark.read.format("binaryFile").load(path)
    return packets(files.select(F.col("path").alias("stream"), "content"))


def coded_frames(payload: Column) -> Column:
    """Array of (start, len) of the frames in a packet; null for a damaged superframe index or an empty packet.

    The last byte of a superframe tells how many frames there are and how wide
    their sizes are; the same byte stands before the sizes.
    """
    size = F.octet_length(payload)

    def frames(m: Column) -> Column:
        wide = F.shiftright(m, 3).bitwiseAND(F.lit(3)).cast("int") + 1
        count = m.bitwiseAND(F.lit(7)).cast("int") + 1
        begin = size - 2 - count * wide

        def little(k: Column) -> Column:
            digits = F.hex(F.substring(payload, begin + 2 + k * wide, wide))
            pairs = F.transform(F.sequence(F.lit(0), wide - 1), lambda i: F.substring(digits, 2 * (wide - 1 - i) + 1, F.lit(2)))
            return F.conv(F.array_join(pairs, ""), 16, 10).cast("long")

        def placed(sizes: Column) -> Column:
            # the sum so far stands beside each frame
            step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], F.struct(s["at"].alias("start"), x.alias("len"))).alias("out"))
            start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,len:bigint>>").alias("out"))
            return bind(F.aggregate(sizes, start, step), lambda s: F.when(s["at"] == begin, s["out"]))

        valid = (begin >= 0) & (bits.big_endian(payload, begin, 1) == m)
        return F.when(valid, bind(F.transform(F.sequence(F.lit(0), count - 1), little), placed))

    alone = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.cast("long").alias("len")))
    marker = bits.big_endian(payload, size - 1, 1)
    return F.when(size > 0, bind(marker, lambda m: F.when(F.shiftright(m, 5) == 6, frames(m)).otherwise(alone)))


def _size(n: int) -> bytes:
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) + n).to_bytes(width, "big")


def element(name: int, *body: bytes) -> bytes:
    """An element with its identifier and size."""
    body = b"".join(body)
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


#: Further element identifiers of written files.
_VERSIONS = {0x4286: 1, 0x42F7: 1, 0x42F2: 4, 0x42F3: 8, 0x4287: 4, 0x4285: 2}


def _prelude(width: int, height: int) -> tuple[bytes, bytes]:
    """What stands before the segment, and what it begins with."""
    head = element(EBML, *[_number(k, v) for k, v in _VERSIONS.items()], element(DOC_TYPE, b"webm"))
    video = element(VIDEO, _number(WIDTH, width), _number(HEIGHT, height))
    track = element(TRACK, _number(NUMBER, 1), _number(0x73C5, 1), _number(TYPE, 1), _number(0x9C, 0), element(CODEC, b"V_VP9"), video)
    return head, element(INFO, _number(SCALE, 1_000_000)) + element(TRACKS, track)


def webm_head(width: int, height: int) -> bytes:
    """The beginning of a file whose segment has no end yet."""
    head, body = _prelude(width, height)
    return head + SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body


def webm_cluster(rows: list[tuple[int, int, bool, bytes]]) -> bytes:
    """A cluster of (cluster, ms, keyframe, payload); its first packet gives its time."""
    base = rows[0][1]
    blocks = [element(SIMPLE, b"\x81", struct.pack(">hB", ms - base, 0x80 if key else 0), payload) for _, ms, key, payload in rows]
    return element(CLUSTER, _number(TIMESTAMP, base), *blocks)


def write_webm(width: int, height: int, rows: Iterable[tuple[int, int, bool, bytes]]) -> bytes:
    """A WebM file of (cluster, ms, keyframe, payload) in order."""
    head, body = _prelude(width, height)
    clusters: dict[int, list] = {}
    for row in rows:
        clusters.setdefault(row[0], []).append(row)
    return head + element(SEGMENT, body, *map(webm_cluster, clusters.values()))


def mux(rows: DataFrame, stream: str, width: int, height: int) -> DataFrame:
    """(stream, content): a WebM file for each stream of ``rows`` (stream, packet_index, cluster, ms, keyframe, payload).

    A file is written as a whole, so one stream must fit into a task, as it must
    into the file's reader.
    """
    kind = rows.schema[stream].dataType.simpleString()

    def write(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("packet_index")
        content = write_webm(width, height, zip(*(table.column(c).to_pylist() for c in ("cluster", "ms", "keyframe", "payload"))))
        return pa.table({stream: pa.array([key[0].as_py()], table.schema.field(stream).type), "content": pa.array([content], pa.binary())})

    return rows.groupBy(stream).applyInArrow(write, f"`{stream}` {kind}, content binary")


def round_trip(sent: DataFrame, got: DataFrame, stream: str, width: int, height: int) -> DataFrame:
    """Packets of ``sent`` and ``got`` (stream, packet_index, ts, keyframe, payload) by place, and whether they and the container's sizes agree."""
    a = sent.select(stream, "packet_index", F.col("ts").alias("__ts"), F.col("keyframe").alias("__key"), F.octet_length("payload").alias("__size"))
    b = got.select(stream, "packet_index", "ts", "keyframe", F.octet_length("payload").alias("size"), ((F.col("width") == width) & (F.col("height") == height)).alias("__sized"))
    same = F.coalesce("__sized", F.lit(False)) & F.col("ts").eqNullSafe(F.col("__ts")) & F.col("keyframe").eqNullSafe(F.col("__key")) & F.col("size").eqNullSafe(F.col("__size"))
    return a.join(b, [stream, "packet_index"], "full_outer").select(stream, "packet_index", "ts", "keyframe", F.col("size").cast("long").alias("size"), same.alias("same"))
