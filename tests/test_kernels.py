"""Headers bit by bit, transforms, planes, neighbours and texts against plain versions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from framelake.functions import cursor, texts, transforms
from framelake.operators import corpus, frames, planes
from framelake.sources import logs


def _bits(*parts):
    return "".join(f"{value:0{n}b}" if n else "" for value, n in parts)


def _frame(rest, width=320, resilient=0, size=200):
    head = _bits((2, 2), (0, 2), (0, 1), (0, 1), (1, 1), (resilient, 1), (0x498342, 24), (2, 3), (0, 1), (width - 1, 16), (239, 16), (0, 1))
    text = (head + rest).ljust(8 * size, "0")
    return bytearray(int(text[k : k + 8], 2) for k in range(0, 8 * size, 8))


PLAIN = _bits((1, 1), (0, 1), (3, 2), (9, 6), (5, 3), (0, 1), (77, 8), (0, 1), (0, 1), (0, 1), (0, 1))
TILES = _bits((0, 1), (11, 16))  # a width of 320 has 5 superblocks and no choice but one tile column


def _fields(spark, *data):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(data)], "k int, data binary")
    rows = rows.select("k", "data", frames.key_header(F.col("data")).alias("h"))
    return {r.k: r.f for r in rows.select("k", frames.key_fields(F.col("data"), F.col("h")).alias("f")).collect()}


def test_header_fields(spark):
    short = PLAIN[2:]
    deltas = _bits((1, 1), (1, 1), (1, 1), (5, 6), (1, 1), (0, 1), (1, 1), (63, 6), (0, 1), (0, 1), (1, 1), (2, 6), (1, 1), (0, 1))
    filtered = PLAIN[:13] + deltas + PLAIN[14:]
    segments = _bits((1, 1), (0, 1), (1, 1), (1, 1)) + _bits((1, 1), (200, 8), (1, 1)) + "0" * 31
    found = _fields(
        spark,
        _frame(PLAIN + TILES), _frame(short + TILES, resilient=1), _frame(filtered + TILES), _frame(PLAIN[:-1] + segments + TILES), _frame(PLAIN[:-1] + segments.replace("1111", "1110", 1).replace("1" + "11001000" + "1", "1" + "11001000" + "0", 1) + TILES),
        _frame(PLAIN + _bits((1, 1), (1, 1), (0, 1), (1, 1), (0, 1), (11, 16)), width=2000), _frame(PLAIN + TILES, size=17), _frame(PLAIN + _bits((0, 1), (190, 16))),
    )
    f = found[0]
    assert (f.refresh_context, f.parallel, f.context, f.level, f.sharpness, f.base_q, f.lossless, f.segmented) == (True, False, 3, 9, 5, 77, False, False)
    assert (f.ref_deltas, f.mode_deltas, f.tree_probabilities, f.compressed_size, f.error) == ([1, 0, -1, -1], [0, 0], [255] * 7, 11, None)
    assert f.compressed_at == math.ceil((69 + len(PLAIN) + len(TILES)) / 8) and f.tiles_at == f.compressed_at + 11
    assert (found[1].refresh_context, found[1].parallel, found[1].level, found[1].error) == (False, True, 9, None)
    assert found[2].ref_deltas == [-5, 0, 63, -1] and found[2].mode_deltas == [-2, 0] and found[2].base_q == 77 and found[2].error is None
    assert found[3].error == "invalid" and found[3].absolute and found[3].features[0] == -200
    assert (found[5].tile_columns_log2, found[5].tile_rows_log2, found[5].compressed_size) == (2, 1, 11)
    assert found[6].error == "invalid" and found[7].error == "invalid"


def test_cursor_ends_with_the_data(spark):
    layout = [cursor.Field("a", 5), cursor.Field("b", 7, signed=True, optional=True), cursor.Field("c", 3, when="a", default=9)]
    rows = spark.createDataFrame([(bytearray([0b00000100, 0b11111010, 0b10000000]),), (bytearray([0b10101000]),), (bytearray([0b10101100]),), (bytearray(),)], "data binary")
    found = rows.select(cursor.bind(cursor.first_bytes(F.col("data"), 4), lambda raw: cursor.read(raw, F.lit(0), layout, {})).alias("r")).collect()
    assert (found[0].r["at"], found[0].r["values"]) == (14, [0, 31, 9])
    assert [r.r["short"] for r in found] == [False, True, True, True]


def _loop(network, values):
    for stage in network:
        values = [(sum(values[i] * f for i, f in terms) + 8192) >> 14 if rounded else sum(values[i] * f for i, f in terms) for terms, rounded in stage]
    return values


@pytest.mark.parametrize(("kind", "n"), [("DCT", 4), ("DCT", 8), ("DCT", 16), ("DCT", 32), ("ADST", 4), ("ADST", 8), ("ADST", 16)])
def test_transforms_come_near_plain_sums(kind, n):
    dice = random.Random(n)
    for _ in range(20):
        x = [dice.randint(-900, 900) for _ in range(n)]
        if kind == "DCT":
            want = [sum(v * (math.sqrt(0.5) if k == 0 else 1) * math.cos((2 * j + 1) * k * math.pi / (2 * n)) for k, v in enumerate(x)) for j in range(n)]
        elif n == 4:
            want = [sum(v * math.sin((j + 1) * (2 * k + 1) * math.pi / 9) for k, v in enumerate(x)) * math.sqrt(8) / 3 for j in range(n)]
        else:
            want = [sum(v * math.sin((2 * j + 1) * (2 * k + 1) * math.pi / (4 * n)) for k, v in enumerate(x)) for j in range(n)]
        assert max(abs(a - b) for a, b in zip(_loop(transforms.network(kind, n), x), want)) < 8
    terms = sum(len(t) for stage in transforms.network(kind, n) for t, _ in stage)
    assert terms <= 6 * n * (n.bit_length() + 1)


def test_hand_vectors_of_transforms(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    n = lambda xs: F.array(*[F.lit(x) for x in xs])
    assert one(transforms.inverse(n([64, 0, 0, 0]), "DCT", 4)) == [45] * 4
    assert one(transforms.inverse(n([0, 64, 0, 0]), "DCT", 4)) == [59, 24, -24, -59]
    assert one(transforms.inverse_block(n([1024] + [0] * 63), 8)) == [16] * 64


@pytest.mark.parametrize(("n", "across", "down"), [(4, "DCT", "ADST"), (8, "ADST", "DCT"), (16, "ADST", "ADST")])
def test_blocks_are_rows_then_columns(spark, n, across, down):
    dice = random.Random(n)
    x = [dice.randint(-300, 300) if k % 3 == 0 else 0 for k in range(n * n)]
    rows = [_loop(transforms.network(across, n), x[r * n : r * n + n]) for r in range(n)]
    columns = [_loop(transforms.network(down, n), [row[c] for row in rows]) for c in range(n)]
    shift = {4: 4, 8: 5, 16: 6}[n]
    want = [(columns[c][r] + (1 << shift - 1)) >> shift for r in range(n) for c in range(n)]
    got = spark.createDataFrame([(x,)], "x array<long>").select(transforms.inverse_block(F.col("x"), n, across, down).alias("y")).first().y
    assert got == want


def test_gather_equals_clamped_places(spark):
    dice = random.Random(2)
    w, h = 37, 29
    plane = [dice.randrange(256) for _ in range(w * h)]
    held = spark.createDataFrame([(1, w, h, plane), (2, 0, 5, [])], "f int, w int, h int, s array<int>")
    rows = [(1, dice.randint(-500, 900), dice.randint(-500, 800), dice.randint(1, 9), dice.randint(1, 7), dice.choice([16, 8, 32]), dice.choice([16, 20])) for _ in range(80)]
    rows += [(2, 0, 0, 1, 1, 16, 16), (3, 0, 0, 1, 1, 16, 16), (1, 0, 0, 40, 1, 16, 16)]
    blocks = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, f int, x long, y long, n int, m int, sx int, sy int")
    tiled = planes.tiles(held, ["f"], "s", "w", "h", 16, 20)
    found = {r.k: r.samples for r in planes.gather(blocks, tiled, ["f"], F.col("x"), F.col("y"), F.col("n"), F.col("m"), F.col("sx"), F.col("sy"), 16, 20).collect()}
    for k, (f, x, y, n, m, sx, sy) in enumerate(rows):
        at = lambda v, size: max(0, min(v >> 4, size - 1))
        want = [plane[at(y + j * sy, h) * w + at(x + i * sx, w)] for j in range(m) for i in range(n)] if f == 1 and n < 40 else None
        assert found[k] == want


def test_neighbours_equal_a_lookup(spark):
    dice = random.Random(3)
    cells = [(f, r, c, dice.choice([None, dice.randrange(9)])) for f in (1, 2) for r in range(21) for c in range(26) if dice.random() < 0.8]
    table = spark.createDataFrame(cells, "f int, r int, c int, v int")
    offsets = [(-1, 0), (0, -1), (-3, 2), (2, -4), (0, 3)]
    left = F.floor(F.col("c") / 10) * 10
    found = {(r.f, r.r, r.c): r.candidates for r in planes.neighbours(table, ["f"], "r", "c", F.col("v"), offsets, left, left + 10).collect()}
    held = {x[:3]: x[3] for x in cells}
    assert len(found) == len(cells)
    for f, r, c, _ in cells:
        assert found[f, r, c] == [held.get((f, r + a, c + b)) if (c + b) // 10 == c // 10 and c + b >= 0 else None for a, b in offsets]


def test_one_decimal_by_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    dice = random.Random(5)
    values = [1150.0, 1250.0, 1050.0, 999999.0, 1999950.0, 9950.0, 1e15, 123456789012345.0, 1e21, *[dice.random() * 10 ** dice.randint(3, 12) + 1000 for _ in range(200)]]
    found = [r.t for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(texts.compact_number(F.col("v")).alias("t")).collect()]
    assert found == [f"{Decimal(v / 1000).quantize(Decimal('0.1'), ROUND_HALF_UP)}k" for v in values]


def test_mangled_names():
    one = texts.unmangled
    assert one("_ZN4core3ptr17h0123456789abcdefE") == "core::ptr"
    assert one("_ZN9_$LT$u8$GT$3fooE".replace("9_", "11_")) == "<u8>::foo"
    assert one("_ZN6a..b$C1cE".replace("6a..b$C1c", "7a..b$C$1c")) == "a::b,::c"
    assert one("_ZN4$u7eE".replace("4$u7e", "5$u7e$")) == "~"
    for odd in ("_ZN3fooX", "_ZN9fooE", "main", "", "_ZN03fooE", "_ZNxE"):
        assert one(odd) == odd


def test_failed_runs_tell_why(spark):
    rows = [('{"ok": false, "mismatchedCount": 3, "error": ""}', " e1\n"), ('{"ok": true}', "x"), ("", None), ('{"ok": false}', ""), ('x\n{"mismatches": [1, {"a": null}], "extraCount": 2}', "")]
    table = spark.createDataFrame(rows, "o string, e string").select(logs.run_verdict(F.col("o"), F.col("e")).alias("v"))
    assert [r.v.detail for r in table.collect()] == ['{"mismatchedCount": 3}\n  e1', "", "unparseable driver output", "{}", '{"extraCount": 2, "mismatches": [1,{"a":null}]}']


def test_reports_of_missing_and_extra_frames(spark):
    import json

    rows = [("a", 0, "x", "x"), ("a", 1, None, "y"), ("b", 0, "x", None), ("c", 0, "x", "z"), ("d", 0, "x", "x")]
    table = spark.createDataFrame(rows, "s string, frame long, actual string, expected string")
    about = spark.createDataFrame([(k, "ivf", 3) for k in "abcde"], "s string, container string, packetCount long")
    told = {r.s: json.loads(r.report) for r in frames.report(table, "s", about=about).collect()}
    assert {k: v["ok"] for k, v in told.items()} == {"a": False, "b": False, "c": False, "d": True, "e": True}
    assert (told["a"]["missingCount"], told["b"]["extraCount"], told["c"]["mismatchedCount"], told["d"]["container"]) == (1, 1, 1, "ivf")
    lenient = {r.s: json.loads(r.report)["ok"] for r in frames.report(table, "s", allow_mismatch=True).collect()}
    assert lenient == {"a": False, "b": False, "c": True, "d": True}


def test_sidecar_facts(spark):
    cases = [(b"a" * 32 + b" x\n\n" + b"b" * 32, True, None), (b"A" * 32 + b" x", False, None), (b"\n \n", False, None), (b"\xff", False, None), (b"", False, None)]
    cases += [(b"A" * 64 + b"  f\nsource md5 d p q\n", False, ("a" * 64, ["md5", "d", "p q"])), (b"a" * 64, False, ("a" * 64, None)), (b"a" * 63 + b" x", False, None)]
    files = spark.createDataFrame([(str(k), True, bytearray(x)) for k, (x, _, _) in enumerate(cases)], "path string, is_file boolean, content binary")
    found = {int(r.path): r for r in corpus.file_facts(files, "path").collect()}
    for k, (_, lists, record) in enumerate(cases):
        assert bool(found[k].lists_md5) == lists, k
        assert (found[k].record and (found[k].record.digest, found[k].record.source)) == record, k
