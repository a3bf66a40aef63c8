"""Scans over ranges against plain loops, the size of ranges, and inherited values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import lineage, ordering, scan


@pytest.fixture
def rows(spark):
    dice, out = random.Random(5), []
    for stream, size in ((1, 900), (2, 4), (None, 60), *((k, 12) for k in range(3, 150))):
        out += [(stream, i, dice.randrange(256), dice.choice([None, dice.randrange(50)])) for i in range(size)]
    dice.shuffle(out)
    return spark.createDataFrame(out, "s long, i long, bits long, v long"), out


def _by_stream(rows):
    streams = {}
    for row in sorted(rows, key=lambda r: r[1]):
        streams.setdefault(row[0], []).append(row)
    return streams


@pytest.mark.parametrize(("ranges", "fan"), [(1, 64), (37, 64), (37, 3), (200, 4)])
@pytest.mark.parametrize("inclusive", [True, False])
def test_scans_equal_loops(spark, rows, monkeypatch, ranges, fan, inclusive):
    monkeypatch.setattr(scan, "FAN", fan)
    table, plain = rows
    order = ["i"]
    found = {}
    flagged = [F.when(F.shiftright("bits", k).bitwiseAND(F.lit(1)) == 1, F.col("i")) for k in range(8)]
    for name, step in (("sum", scan.total(F.col("bits"))), ("last", scan.latest(F.col("v"), order)), ("each", scan.latest_each(flagged, order))):
        got = scan.scan(table, ["s"], order, step, name, inclusive, ranges).collect()
        assert len(got) == len(plain)
        found[name] = {(r.s, r.i): r[name] for r in got}
    for stream, part in _by_stream(plain).items():
        total, last, each = None, None, [None] * 8
        for at, (_, i, bits, v) in enumerate(part):
            if not inclusive:
                assert found["sum"][stream, i] == total and found["last"][stream, i] == last
                assert (found["each"][stream, i] or [None] * 8) == each
            total = (total or 0) + bits
            last = last if v is None else v
            each = [i if bits >> k & 1 else x for k, x in enumerate(each)]
            if inclusive:
                assert found["sum"][stream, i] == total and found["last"][stream, i] == last and found["each"][stream, i] == each


def test_a_stream_with_a_third_of_the_rows_fills_no_task(spark):
    """Rows that each task of a scan has: the greatest is at most twice the median."""
    table = spark.range(60_000).selectExpr("if(id % 3 = 0, 0, id % 500) AS s", "id AS i", "id % 7 AS v")
    done = scan.scan(table, ["s"], ["i"], scan.total(F.col("v")), "sum", ranges=30)
    dealt = table.repartitionByRange(30, "s", "i").groupBy(F.spark_partition_id().alias("r")).count()
    sizes = sorted(r["count"] for r in dealt.collect())
    assert len(sizes) == 30 and sizes[-1] <= 2 * sizes[15]
    assert done.filter("s = 0").agg(F.max("sum")).first()[0] == sum(i % 7 for i in range(60_000) if i % 3 == 0 or i % 500 == 0)


def test_ring_and_peak_equal_plain_ones(spark, rows):
    table, plain = rows
    kept = {(r.s, r.i) for r in ordering.ring(table, "s", [F.desc("i")], 100).collect()}
    assert kept == {(r[0], r[1]) for part in _by_stream(plain).values() for r in part[-100:]}
    best = {r.s: r.i for r in ordering.peak(table, "s", F.col("v") / 2, "i").collect()}
    for stream, part in _by_stream(plain).items():
        assert best[stream] == min(part, key=lambda r: (r[3] is None, -(r[3] or 0), r[1]))[1]


def test_a_chain_of_ten_thousand_frames_takes_few_steps(spark, monkeypatch):
    stored = []
    original = lineage.materialise
    monkeypatch.setattr(lineage, "materialise", lambda df, label: stored.append(label) or original(df, label))
    chain = spark.range(10_000).selectExpr("1 AS s", "id AS f", "nullif(id, 0) - 1 AS up", "if(id = 0, 77, NULL) AS v")
    more = spark.createDataFrame([(2, 1, 2, None), (2, 2, 1, None), (2, 3, 9, None), (2, 4, None, None), (None, 1, None, 5), (None, 2, 1, None), (2, 5, 4, 6)], "s int, f long, up long, v int")
    found = {(r.s, r.f): r.size for r in lineage.inherit(chain.unionByName(more), "s", "f", F.col("up"), F.col("v"), "size").collect()}
    assert all(found[1, k] == 77 for k in range(10_000)) and len(stored) < 20
    assert {k: v for k, v in found.items() if k[0] != 1} == {(2, 1): None, (2, 2): None, (2, 3): None, (2, 4): None, (None, 1): 5, (None, 2): 5, (2, 5): 6}
