"""Files as Spark data sources: media read by many tasks, growing logs read by byte offset, files written as a transaction.

Call :func:`register` once for each session; then

- ``spark.read.format("framelake_media").load(path)`` gives the rows of
  ``media.packets``.  A large file is cut at clusters or packets: a first pass
  reads the heads of elements alone, and each task reads a range of bytes.
- ``spark.readStream.format("framelake_log").load(folder)`` follows files that
  grow.  An offset holds a number of bytes for each file, always after a line's
  end, so half a line waits and a restart repeats nothing.
- ``df.write.format("framelake_webm")`` and ``"framelake_lines"`` write one file
  for each stream or name.  Tasks write beside the final places; files move
  there when all tasks have ended, and none is left if one fails.

Paths are URIs that Arrow's file systems know (local, HDFS, object stores).
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from . import media

#: Bytes of a file that one task reads, about.
SPLIT = 64 << 20
CHUNK = 1 << 20


def open_path(path: str) -> tuple[arrow_fs.FileSystem, str, str]:
    """(file system, path in it, what stands before that path in full names)."""
    path = re.sub(r"^file:/*(?=/)", "", path)
    system, inner = arrow_fs.FileSystem.from_uri(path)
    before = "file:" if isinstance(system, arrow_fs.LocalFileSystem) else path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return system, inner, before


def list_files(system: arrow_fs.FileSystem, path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all in a folder whose names and folders don't begin with a dot or an underscore."""
    found = system.get_file_info(path)
    if found.type == arrow_fs.FileType.File:
        return [(path, found.size)]
    inside = system.get_file_info(arrow_fs.FileSelector(path, recursive=True))
    hidden = re.compile(r"(^|/)[._]")
    return sorted((x.path, x.size) for x in inside if x.type == arrow_fs.FileType.File and not hidden.search(x.path[len(path) :]))


class Heads:
    """Bytes of a file at any place, a few kilobytes at a time."""

    def __init__(self, file, size: int, ahead: int = 4096) -> None:
        self.file, self.size, self.ahead = file, size, ahead
        self.at, self.data = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes; fewer at the file's end."""
        if not self.at <= at or at + n > self.at + len(self.data):
            self.at, self.data = at, self.file.read_at(max(n, self.ahead), at)
        return self.data[at - self.at : at - self.at + n]

    def head(self, at: int) -> tuple[int, int | None, int]:
        """(identifier, size, begin) of the element at ``at``."""
        data = self.get(at, 12)
        name, begin = media.read_vint(data, 0, True)
        size, begin = media.read_vint(data, begin)
        return name, size, at + begin

    def inside(self, at: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(identifier, begin, end) of the elements between two places, which must fit."""
        while at < end:
            name, size, begin = self.head(at)
            if size is None or begin + size > end:
                raise media.Damaged("element exceeds its parent")
            yield name, begin, begin + size
            at = begin + size


@dataclass
class Cut:
    """Where a range of a file begins, and what its reader knows by then."""

    at: int = 0
    n: int = 0
    known: dict = field(default_factory=dict)


def _count(heads: Heads, begin: int, end: int, track: int) -> int:
    """Packets of the track in a cluster; any damage in it raises."""
    n = 0
    for name, x, y in heads.inside(begin, end):
        blocks = [(x, y)] if name == media.SIMPLE else [(u, v) for part, u, v in heads.inside(x, y) if part == media.BLOCK] if name == media.GROUP else []
        if name == media.TIMESTAMP and (y - x > 8 or int.from_bytes(heads.get(x, y - x), "big") >= 1 << 53):
            raise media.Damaged("integer is too wide")
        for u, v in blocks:
            data = heads.get(u, min(12, v - u))
            number, at = media.read_vint(data, 0)
            if at + 3 > v - u or (number == track and data[at + 2] & 6):
                raise media.Damaged("damaged block")
            n += number == track
    return n


def _webm_cuts(heads: Heads, split: int) -> Iterator[Cut]:
    reader, at, last, end, n, inside = media.Webm(), 0, 0, None, 0, False
    while at < heads.size:
        name, size, begin = heads.head(at)
        if name == media.SEGMENT and not inside:
            at, inside, end = begin, True, None if size is None else begin + size
            continue
        if size is None or begin + size > (heads.size if end is None else min(end, heads.size)):
            return
        if name in (media.EBML, media.INFO, media.TRACKS) and (inside or name == media.EBML):
            list(reader._take(name, heads.get(begin, size), 0, size))
        elif name == media.CLUSTER and inside:
            if reader.header is None:
                reader._describe()
            if at - last >= split:
                yield Cut(at, n, {"header": reader.header, "track": reader.track, "scale": reader.scale, "tracks": reader.tracks, "inside": True, "left": None if end is None else end - at})
                last = at
            n += _count(heads, begin, begin + size, reader.track)
        at = begin + size
        if end is not None and at >= end:
            return


def _ivf_cuts(heads: Heads, split: int) -> Iterator[Cut]:
    reader = media.Ivf()
    list(reader.push(heads.get(0, 32)))
    at, last, n = 32 + reader.skip, 0, 0
    while at + 12 <= heads.size:
        if at - last >= split:
            yield Cut(at, n, {"header": reader.header})
            last = at
        at += 12 + struct.unpack("<I", heads.get(at, 4))[0]
        n += 1


def cuts(file, size: int, split: int = SPLIT) -> list[Cut]:
    """Where the ranges of a file begin, the first at 0.

    Only heads are read.  A place counts if all before it is sound, so the last
    range alone can meet damage, and meets it as a reader of the whole would.
    """
    out, heads = [Cut()], Heads(file, size)
    make = {b"DKIF": _ivf_cuts, b"\x1aE\xdf\xa3": _webm_cuts}.get(heads.get(0, 4))
    try:
        for cut in make(heads, split) if make else ():
            out.append(cut)
    except (media.Damaged, media.Starved):
        pass
    return out


def range_packets(file, start: Cut, end: int, last: bool) -> Iterator[tuple[dict | None, tuple]]:
    """(header, packet) of the bytes of a file from ``start`` to ``end``, as ``media.parse`` gives them."""
    make = media.READERS.get(bytes(file.read_at(4, 0)))
    if make is None:
        yield None, (None, None, None, None, None, "neither IVF nor WebM")
        return
    reader = make()
    for name, value in start.known.items():
        setattr(reader, name, value)
    reader.n = start.n
    try:
        for at in range(start.at, end, CHUNK):
            for packet in reader.push(file.read_at(min(CHUNK, end - at), at)):
                yield reader.header, (*packet, None)
        if last:
            reader.finish()
    except media.Damaged as why:
        yield reader.header, (None, None, None, None, None, str(why))


class MediaSource(DataSource):
    """Packets of the media files under ``path``; option ``split``: bytes of a file for each task, about."""

    @classmethod
    def name(cls) -> str:
        return "framelake_media"

    def schema(self) -> str:
        return f"stream string, {media.HEADER}, {media.PACKET}"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options["path"], int(self.options.get("split", SPLIT)))


class MediaReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        system, inner, before = open_path(self.path)
        out: list[InputPartition] = []
        small: list[tuple] = []
        room = self.split
        for path, size in list_files(system, inner):
            if size < 2 * self.split:
                small.append((before, path, Cut(), size, True))
                room -= size
                if room <= 0:
                    out.append(InputPartition(small))
                    small, room = [], self.split
                continue
            with system.open_input_file(path) as file:
                begins = cuts(file, size, self.split)
            for k, cut in enumerate(begins):
                last = k + 1 == len(begins)
                out.append(InputPartition([(before, path, cut, size if last else begins[k + 1].at, last)]))
        return out + ([InputPartition(small)] if small or not out else [])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            system, _, _ = open_path(self.path)
            for before, path, start, end, last in partition.value:
                with system.open_input_file(path) as file:
                    for header, packet in range_packets(file, start, end, last):
                        yield f"{before}{path}", header, packet

        return media.packet_batches(found(), "stream", pa.string())


class LogSource(DataSource):
    """(path, at, value): lines of the files in a folder and the byte where each begins, as files grow.

    A file that has become shorter than what was read of it gives nothing until
    it is longer again.
    """

    @classmethod
    def name(cls) -> str:
        return "framelake_log"

    def schema(self) -> str:
        return "path string, at long, value string"

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options["path"], int(self.options.get("split", SPLIT)))


def line_end(file, size: int, known: int, step: int = 1 << 16) -> int:
    """The place after the last line's end in the first ``size`` bytes, or ``known`` if there is none behind it."""
    at = size
    while at > known:
        begin = max(known, at - step)
        found = bytes(file.read_at(at - begin, begin)).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return known


class LogReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split, self.known = path, split, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, inner, before = open_path(self.path)
        for path, size in list_files(system, inner):
            have = self.known.get(before + path, 0)
            if size > have:
                with system.open_input_file(path) as file:
                    have = line_end(file, size, have)
            if have:
                self.known[before + path] = have
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, to in end.items():
            for at in range(start.get(path, 0), to, self.split):
                out.append(InputPartition((path, start.get(path, 0), at, min(at + self.split, to), to)))
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        """Lines that begin in a range; the last one may end behind it."""
        path, first, at, to, end = partition.value
        system, inner, _ = open_path(path)
        kinds = pa.schema([("path", pa.string()), ("at", pa.int64()), ("value", pa.string())])
        with system.open_input_file(inner) as file:
            # the byte before tells whether a line begins here
            place = at if at == first else at - 1
            skip, rest = at != first, b""
            rows: list[tuple] = []
            while place < to or rest:
                more = bytes(file.read_at(min(CHUNK, end - place - len(rest)), place + len(rest)))
                data = rest + more
                lines = data.split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if skip:
                        skip = False
                    elif place < to:
                        rows.append((path, place, line.removesuffix(b"\r").decode("utf-8", "replace")))
                    place += len(line) + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)
                    rows = []
                if place >= to or not more:
                    break

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FilesWriter(DataSourceArrowWriter):
    """One file for each name; rows of one name come one after another in one task."""

    def __init__(self, path: str, suffix: str) -> None:
        self.path, self.suffix = path, suffix
        self.work = f"_temporary-{uuid.uuid4().hex}"

    def begin(self, out) -> None:
        """Write what a file begins with."""

    def add(self, out, row: dict) -> None:
        """Write a row, or hold it."""
        raise NotImplementedError

    def end(self, out) -> None:
        """Write what is held."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner, _ = open_path(self.path)
        folder, files, out, now = f"{inner}/{self.work}/{uuid.uuid4().hex}", [], None, None
        system.create_dir(folder, recursive=True)
        names = set()
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    name = row["name"]
                    if out is None or name != now:
                        if name is None or name in names:
                            raise ValueError(f"rows of file {name} are not together")
                        if out is not None:
                            self.end(out)
                            out.close()
                        names.add(name)
                        final = f"{inner}/{quote(str(name), safe='')}{self.suffix}"
                        files.append((f"{folder}/{len(files)}", final))
                        out, now = system.open_output_stream(files[-1][0]), name
                        self.begin(out)
                    self.add(out, row)
            if out is not None:
                self.end(out)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner, _ = open_path(self.path)
        files = [x for message in messages if message for x in message.files]
        if len({final for _, final in files}) < len(files):
            raise ValueError("several tasks have written one file")
        for place, final in files:
            system.move(place, final)
        system.create_dir(inner, recursive=True)
        if system.get_file_info(f"{inner}/{self.work}").type == arrow_fs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.work}")

    def abort(self, messages: list[Written | None]) -> None:
        system, inner, _ = open_path(self.path)
        if system.get_file_info(f"{inner}/{self.work}").type == arrow_fs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.work}")


class WebmWriter(FilesWriter):
    """WebM files; a cluster at a time is held, and the segment's size is left open."""

    def __init__(self, path: str, width: int, height: int) -> None:
        super().__init__(path, ".webm")
        self.width, self.height = width, height
        self.held: list[tuple] = []

    def begin(self, out) -> None:
        out.write(media.webm_head(self.width, self.height))

    def add(self, out, row: dict) -> None:
        if self.held and self.held[0][0] != row["cluster"]:
            self.end(out)
        self.held.append((row["cluster"], row["ms"], row["keyframe"], row["payload"]))

    def end(self, out) -> None:
        if self.held:
            out.write(media.webm_cluster(self.held))
        self.held = []


class LinesWriter(FilesWriter):
    def __init__(self, path: str) -> None:
        super().__init__(path, "")

    def add(self, out, row: dict) -> None:
        out.write((row["line"] or "").encode() + b"\n")


class WebmSink(DataSource):
    """Rows (name, cluster, ms, keyframe, payload), those of a name together and in order; options width and height."""

    @classmethod
    def name(cls) -> str:
        return "framelake_webm"

    def schema(self) -> str:
        return "name string, cluster long, ms long, keyframe boolean, payload binary"

    def writer(self, schema, overwrite: bool) -> WebmWriter:
        return WebmWriter(self.options["path"], int(self.options["width"]), int(self.options["height"]))


class LinesSink(DataSource):
    """Rows (name, line), those of a name together and in order."""

    @classmethod
    def name(cls) -> str:
        return "framelake_lines"

    def schema(self) -> str:
        return "name string, line string"

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    for source in (MediaSource, LogSource, WebmSink, LinesSink):
        spark.dataSource.register(source)


def read_media(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The rows of ``media.packets`` for the files under ``path``, by the file's full name as stream."""
    register(spark)
    return spark.read.format("framelake_media").option("split", split).load(path)


def follow_log(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """A stream of (path, at, value): lines as the files of a folder grow."""
    register(spark)
    return spark.readStream.format("framelake_log").option("split", split).load(path)


def write_webm(rows: DataFrame, stream: str, path: str, width: int, height: int) -> None:
    """A WebM file for each stream of ``rows`` (stream, packet_index, cluster, ms, keyframe, payload)."""
    register(rows.sparkSession)
    dealt = rows.repartition(stream).sortWithinPartitions(stream, "packet_index")
    some = dealt.selectExpr(f"cast(`{stream}` AS string) AS name", "cast(cluster AS bigint) AS cluster", "cast(ms AS bigint) AS ms", "keyframe", "payload")
    some.write.format("framelake_webm").option("width", width).option("height", height).mode("append").save(path)


def write_lines(rows: DataFrame, name: str, line: str, order: list[str], path: str) -> None:
    """A text file for each name, its lines in order."""
    register(rows.sparkSession)
    dealt = rows.repartition(name).sortWithinPartitions(name, *order)
    dealt.selectExpr(f"cast(`{name}` AS string) AS name", f"cast(`{line}` AS string) AS line").write.format("framelake_lines").mode("append").save(path)
