"""Data sources and sinks: files in ranges, growing logs, transactions, chunks in Spark's state."""

from __future__ import annotations

import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from framelake.sources import files, media
from framelake.streaming import demux

from .test_media import IVF, WEBM, ivf, only


def _long_webm(clusters=40, blocks=6, end=b""):
    rows = [(c, c * 1000 + k, k == 0, bytes([c, k]) * (50 + k)) for c in range(clusters) for k in range(blocks)]
    return media.write_webm(320, 240, rows) + end


LONG_IVF = ivf([(k, bytes([k % 256]) * (20 + k % 7)) for k in range(300)], 36)


def _plain(rows):
    key = lambda p: (p[0] is None, p[0] or 0)
    return sorted(((r.packet_index, r.ts, r.keyframe, r.visible, None if r.payload is None else bytes(r.payload), r.error) for r in rows), key=key)


def _laced(content):
    at = content.rindex(b"\x81" + struct.pack(">hB", 5, 0))
    return content[: at + 3] + b"\x06" + content[at + 4 :]


@pytest.mark.parametrize(
    "content",
    [IVF, WEBM, LONG_IVF, LONG_IVF[:-5], _long_webm(), _long_webm()[:-7], _laced(_long_webm()), _long_webm(end=media.element(0x1C53BB6B, b"cues")), b"", b"RIFF....", LONG_IVF[:30]],
)
def test_ranges_of_a_file_give_the_rows_of_the_whole(tmp_path, content):
    from pyarrow import fs

    (tmp_path / "x").write_bytes(content)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as file:
        for split in (1, 200, 3000, 1 << 20):
            begins = files.cuts(file, len(content), split)
            found = []
            for k, cut in enumerate(begins):
                last = k + 1 == len(begins)
                part = list(files.range_packets(file, cut, len(content) if last else begins[k + 1].at, last))
                assert last or all(p[5] is None for _, p in part)
                found += part
            assert found == list(media.parse(content))
            assert split > 200 or len(content) < 5000 or len(begins) > 10


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    contents = {"a.ivf": LONG_IVF, "b.webm": _long_webm(), "deep/c.webm": WEBM, "bad.ivf": IVF[:-1]}
    for name, content in contents.items():
        (tmp_path / "in" / name).write_bytes(content)
    (tmp_path / "in" / "_hidden").write_bytes(b"x")
    found = files.read_media(spark, f"file://{tmp_path}/in", 3000)
    tasks = found.filter(F.col("stream").endswith("b.webm")).select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks > 3
    for name, content in contents.items():
        rows = found.filter(F.col("stream") == f"file:{tmp_path}/in/{name}").collect()
        assert _plain(rows) == sorted(only(content), key=lambda p: (p[0] is None, p[0] or 0))
    whole = media.read_packets(spark, f"file://{tmp_path}/in/a.ivf")
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, found.filter(F.col("stream").endswith("a.ivf")).collect()))


def test_webm_sink_writes_what_was_sent_and_nothing_if_a_task_fails(spark, tmp_path):
    rows = spark.range(4000).selectExpr("if(id % 3 = 0, 'hot/one', concat('s', id % 20)) AS stream", "id AS packet_index", "id div 500 AS cluster", "id AS ms", "id % 500 = 0 AS keyframe", "cast(md5(cast(id AS string)) AS binary) AS payload")
    path = f"file://{tmp_path}/out"
    files.write_webm(rows, "stream", path, 320, 240)
    assert len(list((tmp_path / "out").iterdir())) == 21
    got = files.read_media(spark, path).filter("error IS NULL")
    sent = rows.groupBy("stream").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"), F.sum(F.crc32("payload")).alias("c"))
    back = got.groupBy("stream").agg(F.count("*").alias("n"), F.sum("ts").alias("ms"), F.sum(F.crc32("payload")).alias("c"))
    assert sorted(tuple(r)[1:] for r in sent.collect()) == sorted(tuple(r)[1:] for r in back.collect())
    failing = rows.withColumn("payload", F.when(F.col("packet_index") == 3333, F.raise_error(F.lit("planted")).cast("binary")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="planted"):
        files.write_webm(failing, "stream", f"file://{tmp_path}/none", 320, 240)
    assert not [x for x in (tmp_path / "none").rglob("*") if x.is_file()]
    with pytest.raises(Exception, match="not together"):
        rows.coalesce(1).selectExpr("stream AS name", "cluster", "ms", "keyframe", "payload").write.format("framelake_webm").option("width", 1).option("height", 1).mode("append").save(f"file://{tmp_path}/none")
    assert not [x for x in (tmp_path / "none").rglob("*") if x.is_file()]


def test_lines_sink(spark, tmp_path):
    rows = spark.range(100).selectExpr("concat('r', id % 3, '.json') AS name", "id", "to_json(struct(id)) AS line")
    files.write_lines(rows, "name", "line", ["id"], f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "r1.json").read_text().splitlines() == [f'{{"id":{k}}}' for k in range(1, 100, 3)]


def _run(query, name, folder):
    query.writeStream.format("parquet").option("path", str(folder / name)).option("checkpointLocation", str(folder / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()


def test_lines_of_growing_files_come_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_bytes(b"one\ntwo\nhal")
    (folder / "b.jsonl").write_bytes(b"long line of this file\r\n" * 40)
    for more in (b"f\nthree\n", b"", b"four", b"\n\xff five\n"):
        _run(files.follow_log(spark, f"file://{folder}", 100), "out", tmp_path)
        with open(folder / "a.jsonl", "ab") as out:
            out.write(more)
    _run(files.follow_log(spark, f"file://{folder}", 100), "out", tmp_path)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    a = sorted((r.at, r.value) for r in rows if r.path.endswith("a.jsonl"))
    assert [v for _, v in a] == ["one", "two", "half", "three", "four", "� five"]
    whole = (folder / "a.jsonl").read_bytes()
    assert all(whole[at:].startswith(v.encode()[:3]) for at, v in a[:-1])
    b = [r.value for r in rows if r.path.endswith("b.jsonl")]
    assert b == ["long line of this file"] * 40


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, demux.STATE_STORE)
    yield
    spark.conf.set(name, before)


CHUNKS = "stream string, seq long, data binary, final boolean"


def _send(spark, folder, rows):
    spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(str(folder))


def test_streamed_chunks_give_the_packets_of_the_whole(spark, tmp_path, rocksdb):
    contents = {"a": IVF, "b": WEBM, "c": IVF[:-1], "d": b"no media", "e": _long_webm(6)}
    dice = random.Random(3)
    sends: list[list] = [[] for _ in range(4)]
    for name, content in contents.items():
        cuts = sorted(dice.sample(range(len(content) + 1), 6))
        parts = [content[a:b] for a, b in zip([0, *cuts], [*cuts, len(content)])]
        for k, part in enumerate(parts):
            sends[dice.randrange(4)].append((name, k, bytearray(part), k == len(parts) - 1))
    sends.append([("a", 0, bytearray(b"late"), False), ("b", 99, bytearray(b"late"), True)])
    for rows in sends:
        _send(spark, tmp_path / "in", rows or [("z", 5, bytearray(), False)])
    chunks = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    _run(demux.packets(chunks), "out", tmp_path)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    for name, content in contents.items():
        assert _plain([r for r in rows if r.stream == name]) == sorted(only(content), key=lambda p: (p[0] is None, p[0] or 0))


def test_state_is_empty_at_the_end(spark, tmp_path, rocksdb):
    _send(spark, tmp_path / "in", [("a", 1, bytearray(IVF[30:]), True), ("a", 0, bytearray(IVF[:30]), False)])
    _run(demux.packets(spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in"))), "out", tmp_path)
    read = spark.read.format("statestore").option("path", str(tmp_path / "out-state"))
    for name in ("bytes", "early"):
        assert read.option("stateVarName", name).load().count() == 0


def test_a_chunk_that_never_comes_is_an_error(spark, tmp_path, rocksdb):
    _send(spark, tmp_path / "in", [("a", 0, bytearray(IVF[:40]), False), ("a", 2, bytearray(IVF[50:]), True)])
    chunks = spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in"))
    query = demux.packets(chunks, patience=1500).writeStream.format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and not spark.table("gaps").filter("error IS NOT NULL").count():
            time.sleep(0.5)
        assert [r.error for r in spark.table("gaps").collect()] == ["chunk 1 is missing"]
    finally:
        query.stop()


def test_bytes_are_loaded_in_proportion_to_what_comes(monkeypatch):
    content, loaded = _long_webm(30, 40), 0
    session, rest, found = demux.Session(), b"", []
    for at in range(0, len(content), 37):
        rest += content[at : at + 37]
        waiting = rest

        def load(waiting=waiting):
            nonlocal loaded
            loaded += len(waiting)
            return waiting

        packets, left = session.feed(min(37, len(content) - at), at + 37 >= len(content), load)
        rest = rest if left is None else left
        found += packets
    assert found == only(content) and loaded < 3 * len(content)
