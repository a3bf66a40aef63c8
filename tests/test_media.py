"""Containers, superframes, headers and streams: hand vectors, damage, and chunking."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from framelake.functions import bits, coding, texts
from framelake.operators import compare, frames, profile
from framelake.sources import logs, media
from framelake.streaming import demux


def ivf(packets, length=32, frames=0):
    head = struct.pack("<4sHH4sHHIII4x", b"DKIF", 0, length, b"VP90", 320, 240, 1000, 1, frames) + bytes(length - 32)
    return head + b"".join(struct.pack("<IQ", len(data), ts) + data for ts, data in packets)


IVF = ivf([(0, b"\1\2\3"), (1, b"\4\5")], 36)
WEBM = media.write_webm(320, 240, [(0, 10, True, b"abc"), (0, 15, False, b"d"), (1, 40_000, True, b"ef")])


def only(content):
    return [packet for _, packet in media.parse(content)]


def test_ivf_packets():
    header, first = next(media.parse(IVF))
    assert (header["width"], header["tb_den"], header["tb_num"]) == (320, 1000, 1)
    assert first == (0, 0, None, None, b"\1\2\3", None)
    assert [p[:2] + p[4:5] for p in only(IVF)] == [(0, 0, b"\1\2\3"), (1, 1, b"\4\5")]


@pytest.mark.parametrize("content", [b"", b"RIFF", IVF[:20], IVF[:-1], IVF[:-3], ivf([]), IVF.replace(b"VP90", b"VP80"), WEBM[:-1], WEBM[:30], WEBM.replace(b"V_VP9", b"V_VP8"), WEBM.replace(b"webm", b"mkvv")])
def test_damage_gives_one_error(content):
    found = only(content)
    assert found[-1][5] and all(p[5] is None for p in found[:-1])


def test_webm_packets():
    assert [p[:5] for p in only(WEBM)] == [(0, 10, True, True, b"abc"), (1, 15, False, True, b"d"), (2, 40_000, True, True, b"ef")]


def test_webm_groups_other_tracks_and_unknown_size():
    e, n = media.element, lambda k, v: media.element(k, v.to_bytes(2, "big"))
    video = e(media.VIDEO, n(media.WIDTH, 8), n(media.HEIGHT, 8))
    track = e(media.TRACK, n(media.NUMBER, 1), n(media.TYPE, 1), e(media.CODEC, b"V_VP9"), video)
    sound = e(media.TRACK, n(media.NUMBER, 2), n(media.TYPE, 2), e(media.CODEC, b"A_OPUS"))
    block = lambda t, rel, flags: bytes([0x80 | t]) + struct.pack(">hB", rel, flags) + b"x"
    cluster = e(
        media.CLUSTER, e(media.SIMPLE, block(1, 5, 0x80)), n(media.TIMESTAMP, 10), e(media.SIMPLE, block(2, 6, 0)), e(media.GROUP, e(media.BLOCK, block(1, 7, 8))),
        e(media.GROUP, e(media.BLOCK, block(1, 8, 0)), e(media.REFERENCE, b"\1")),
    )
    cues = e(0x1C53BB6B, b"cues")
    body = e(media.TRACKS, sound, track) + cues + cluster
    content = e(media.EBML, e(media.DOC_TYPE, b"webm")) + b"\x18\x53\x80\x67\xff" + body
    assert [p[1:4] for p in only(content)] == [(15, True, True), (17, True, False), (18, False, True)]
    laced = body.replace(block(1, 5, 0x80), block(1, 5, 0x82))
    assert "laced" in only(content[: -len(body)] + laced)[-1][5]


@pytest.mark.parametrize("content", [IVF, WEBM])
def test_any_chunking_gives_the_same_packets(content):
    dice = random.Random(1)
    for _ in range(60):
        cuts = sorted(dice.sample(range(len(content) + 1), dice.randint(0, 12)))
        reader, found = media.READERS[content[:4]](), []
        for a, b in zip([0, *cuts], [*cuts, len(content)]):
            found += reader.push(content[a:b])
        reader.finish()
        assert [(*p, None) for p in found] == only(content)


def test_followed_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"type": "turn.started"}\n\nnot json\n')
    (tmp_path / "in" / "b.jsonl").write_text('{"type": "x"}\n{"type": ')
    found = demux.follow_events(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    found.start().awaitTermination()
    assert sorted(r.route for r in spark.table("followed").collect()) == ["malformed", "other", "turn.started"]


def test_files_in_a_folder(spark, tmp_path):
    (tmp_path / "a.ivf").write_bytes(IVF)
    (tmp_path / "b.webm").write_bytes(WEBM)
    rows = media.read_packets(spark, f"file://{tmp_path}").select(F.element_at(F.split("stream", "/"), -1).alias("f"), "packet_index", "container").collect()
    assert sorted(map(tuple, rows)) == [("a.ivf", 0, "ivf"), ("a.ivf", 1, "ivf"), ("b.webm", 0, "webm"), ("b.webm", 1, "webm"), ("b.webm", 2, "webm")]


def test_numbers_of_a_long_stream_run_through_all_ranges(spark):
    rows = spark.range(5000).selectExpr("IF(id % 3 = 0, 'hot', concat('s', id % 40)) AS stream", "id * 7919 % 5003 AS at")
    found = compare.number(rows.repartition(9), "stream", "at").collect()
    want: dict = {}
    for r in sorted(found, key=lambda r: (r.stream, r["at"])):
        want.setdefault(r.stream, []).append(r["frame"])
    assert len(found) == 5000 and all(x == list(range(len(x))) for x in want.values())
    assert compare.number(rows.limit(0), "stream", "at").collect() == []


def test_empty_tables(spark):
    files = spark.createDataFrame([], "stream string, content binary")
    assert media.packets(files).collect() == []
    assert logs.profile_records(files, "stream", "content").collect() == []
    assert logs.compiled_functions(files, "stream", "content").collect() == []


@pytest.mark.parametrize(
    ("packet", "want"),
    [
        ("010203", [(0, 3)]),
        ("0102030405c10203c1", [(0, 2), (2, 3)]),
        ("0102c1", None),
        ("0102030405c00203c1", None),
        ("0102030405c10402c1", None),
        ("", None),
        ("41c900010000c9", None),
        ("41c801000000c8", None),
        ("41d0010000d0", [(0, 1)]),
    ],
)
def test_superframes(spark, packet, want):
    row = spark.range(1).select(media.coded_frames(F.unhex(F.lit(packet))).alias("f")).first()
    assert (row.f and [(x.start, x.len) for x in row.f]) == want


def test_variable_length_integers(spark):
    cases = {"82": (2, 1, False), "407f": (127, 2, False), "ff": (127, 1, True), "00": None, "40": None, "01ffffffffffffff": ((1 << 56) - 1, 8, True)}
    for text, want in cases.items():
        found = spark.range(1).select(bits.vint(F.unhex(F.lit(text)), 0).alias("v")).first().v
        assert (found and tuple(found)) == want
    assert spark.range(1).select(bits.vint(F.unhex(F.lit("1a45dfa3")), 0, True)["value"].alias("v")).first().v == 0x1A45DFA3


def test_nearest_symbol_only(spark):
    samples = spark.createDataFrame([(1, 500), (2, 15), (3, 2000), (4, 5), (5, 40_000_000), (6, 10**7)], "sample long, ip long")
    jit = spark.createDataFrame([(0, 1000, "A", 1), (10, 20, "old", 2), (10, 20, "B", 3), (30_000_000, 50_000_000, "far", 4)], "start long, end long, symbol string, order long")
    maps = spark.createDataFrame([(0, 600, "first", 1), (400, 600, "second", 2), (0, 10**8, "wide", 0)], "start long, end long, symbol string, record long")
    found = {r["sample"]: r["symbol"] for r in profile.attribute(samples, jit, maps).collect()}
    assert found == {1: "second", 2: "B", 3: "wide", 4: "A", 5: "far", 6: "wide"}


def test_hand_vectors(spark):
    n = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(coding.inverse_remap(F.lit(0), F.lit(128))) == 124
    assert [one(coding.merge_probability(F.lit(p), F.lit(a), F.lit(b), 20, 128)) for p, a, b in ((128, 0, 0), (128, 20, 0), (200, 0, 20), (128, 1, 1))] == [128, 192, 101, 128]
    block = [4, -8, 12, -16, 20, -24] + [0] * 10
    assert one(coding.walsh_hadamard_block(n(block))) == [0, 0, 2, 5, -1, -1, 1, 5, -1, 0, -4, 0, -1, 0, -4, 0]
    assert one(coding.predict("DC", n([10, 20, 30, 40] * 2), n([50, 60, 70, 80]), F.lit(0), 4)) == [45] * 16
    tm = one(coding.predict("TM", n([250, 10, 100, 200] * 2), n([250, 10, 100, 0]), F.lit(100), 4))
    assert [tm[k] for k in (0, 5, 10, 15)] == [255, 0, 100, 100]
    assert one(coding.predict("D45", n(range(10, 90, 10)), n([0] * 4), F.lit(0), 4)) == [20, 30, 40, 50, 30, 40, 50, 60, 40, 50, 60, 70, 50, 60, 70, 80]
    assert one(coding.predict("D207", n([0] * 8), n([10, 20, 30, 40]), F.lit(0), 4)) == [15, 20, 25, 30, 25, 30, 35, 38, 35, 38, 40, 40, 40, 40, 40, 40]
    rows = [[0] * 9 for _ in range(9)]
    rows[3][3], rows[3][4], rows[4][3], rows[4][4] = 10, 30, 50, 90
    assert one(coding.interpolate_block(n([x for r in rows for x in r]), 9, 1, 1, coding.bilinear_taps(8), coding.bilinear_taps(8))) == [45]
    assert one(texts.parse_midr(F.lit("0x410fd050"))) == 0x410FD050
    assert texts.unmangled("_ZN4core3ptr17h0123456789abcdefE") == "core::ptr"
    size = one(frames.name_size(F.lit("vp90-2-resize-10x20-3.i420")))
    assert (size.width, size.height) == (10, 20)


def test_last_seconds_of_a_number_beyond_2_53(spark):
    ip = (1 << 62) + 12345
    samples = spark.createDataFrame([(1, ip), (2, ip + 1)], "sample long, ip long")
    jit = spark.createDataFrame([(ip, ip + 1, "A", 1)], "start long, end long, symbol string, order long")
    maps = spark.createDataFrame([], "start long, end long, symbol string, record long")
    assert {r["sample"]: r["symbol"] for r in profile.attribute(samples, jit, maps).collect()} == {1: "A", 2: "<unmapped>"}


def test_truncation_in_the_middle_of_a_character(spark):
    row = spark.range(1).select(texts.truncated(F.lit("é" * 9), 3, 3).alias("t")).first().t
    assert row.truncated and row.original_bytes == 18 and row.head == "é�" and row.tail == "�é"
    row = spark.range(1).select(texts.truncated(F.lit("short"), 3, 3).alias("t")).first().t
    assert (row.truncated, row.head, row.tail) == (False, "short", None)
