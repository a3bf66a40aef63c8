"""Clusters of streams that span many ranges of packets, against a plain loop."""

from __future__ import annotations

import random

import pytest

from framelake.operators import ordering


def _loop(packets, longest):
    out, start, n = [], None, -1
    for ms, key in packets:
        if n < 0 or key or ms - start > longest or ms < start:
            start, n = ms, n + 1
        out.append((start, n))
    return out


@pytest.mark.parametrize("keys", [0, 0.02])
def test_steps_equal_a_loop_from_every_start(keys):
    rng = random.Random(3)
    for _ in range(200):
        at, packets = 100, []
        for _ in range(rng.randrange(1, 40)):
            at += rng.choice([1, 3, 9, -4, 25])
            packets.append((at, rng.random() < keys))
        steps = ordering._steps(packets, 20)
        for start in range(0, 400):
            low, same, end, opened = [x for x in steps if x[0] <= start][-1]
            want = list(ordering._fold(packets, 20, (start, 0)))[-1]
            assert (start if same else end, opened) == want


def test_a_hot_stream_is_dealt_over_many_ranges(spark):
    rng, rows, want = random.Random(4), [], {}
    for stream, size in ((1, 3000), (2, 5), (3, 400), (None, 30)):
        at, packets = 0, []
        for _ in range(size):
            at += rng.choice([10, 40, 700, -300])
            packets.append((at, rng.random() < 0.002))
        rows += [(stream, i, *p) for i, p in enumerate(packets)]
        want |= {(stream, i): n for i, (_, n) in enumerate(_loop(packets, 5000))}
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "user long, i long, ms long, key boolean")
    found = ordering.mux_clusters(table, "user", "i", "ms", "key", 5000, chunk=100).collect()
    assert {(r.user, r.i): r.cluster for r in found} == want and len(found) == len(want)
