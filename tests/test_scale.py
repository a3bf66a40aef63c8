"""Queries that large tables broke: what they do for each row, and how rows are dealt, against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framelake.functions import coding
from framelake.operators import planes
from framelake.plans import kernels, media  # noqa: F401  (they register their queries)
from framelake.plans import queries as plans

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_no_side_of_a_gather_is_broadcast(spark):
    assert "BroadcastHashJoin" not in _plan(plans.QUERIES["gather_blocks"](spark, SF))


def test_tiles_end_with_their_plane(spark):
    w, h, tile, border = 21, 13, 8, 12
    held = spark.createDataFrame([(1, w, h, list(range(w * h)))], "f int, w int, h int, s array<int>")
    found = {(r.tile_row, r.tile_column): r.samples for r in planes.tiles(held, ["f"], "s", "w", "h", tile, border).collect()}
    across = lambda at, size: range(at * tile, min(at * tile + tile + border, size))
    assert found == {(i, j): [y * w + x for y in across(i, h) for x in across(j, w)] for i in range(2) for j in range(3)}


def _plain(mode, above, left, corner, n):
    """Each sample by itself."""
    edge = [*left[::-1], corner, *above[:n]]
    two, three = lambda e, k: (e[k] + e[k + 1] + 1) >> 1, lambda e, k: (e[k] + 2 * e[k + 1] + e[k + 2] + 2) >> 2
    last = [*left, *[left[-1]] * (2 * n)]

    def one(r, c):
        if mode == "D45":
            return three([*above, above[-1]], r + c) if r + c + 2 < 2 * n else above[-1]
        if mode == "D63":
            return (three if r % 2 else two)(above, r // 2 + c)
        if mode == "D207":
            return (three if c % 2 else two)(last, r + c // 2)
        if mode == "D135":
            return three(edge, n + c - r - 1)
        if mode == "D117":
            at = n + c - r // 2
            return three(edge, n - r + 2 * c) if r - 2 * c > 1 else three(edge, at - 1) if r % 2 else two(edge, at)
        if mode == "D153":
            at = n - r + c // 2
            return three(edge, n + c - 2 * r - 2) if c - 2 * r > 1 else three(edge, at - 1) if c % 2 else two(edge, at - 1)
        return {"V": above[c], "H": left[r], "TM": min(max(left[r] + above[c] - corner, 0), 255)}[mode]

    return [one(r, c) for r in range(n) for c in range(n)]


@pytest.mark.parametrize("n", [4, 8, 16])
def test_predicted_rows_equal_samples_one_by_one(spark, n):
    dice = random.Random(n)
    above, left, corner = [dice.randrange(256) for _ in range(2 * n)], [dice.randrange(256) for _ in range(n)], dice.randrange(256)
    row = spark.createDataFrame([(above, left, corner)], "a array<long>, l array<long>, k long")
    modes = [m for m in coding.MODES if m != "DC"]
    made = lambda mode, **kind: coding.predict(mode, F.col("a"), F.col("l"), F.col("k"), n, **kind)
    found = row.select(*[made(m).alias(m) for m in modes], *[made(m, kind="string").alias(f"{m}_text") for m in modes]).first()
    for mode in modes:
        want = _plain(mode, above, left, corner, n)
        assert found[mode] == want and found[f"{mode}_text"] == [str(x) for x in want], mode


def test_small_files_are_dealt_over_many_tasks(spark):
    for name in ("intra_sizes", "gather_blocks"):
        assert "REPARTITION_BY_NUM" in _plan(plans.QUERIES[name](spark, SF)), name


@pytest.mark.parametrize("name", ["inverse_transforms", "keyframe_header"])
def test_work_on_rows_of_a_small_file_is_dealt(spark, name):
    assert "REPARTITION_BY_NUM" in _plan(plans.QUERIES[name](spark, SF))


def test_shown_frames_are_told_before_they_are_filtered(spark):
    plan = _plan(plans.QUERIES["shown_frames"](spark, SF))
    assert "unhex" not in plan and "aggregate" not in plan


def test_no_pattern_runs_over_the_path_of_each_packet(spark):
    found = plans.QUERIES["media_files"](spark, SF)
    assert "regexp" not in _plan(found)
    assert {r.name for r in found.select("name").distinct().collect()} == {str(r[0]) for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().collect()}
