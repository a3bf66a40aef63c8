"""Every query of the plans against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from framelake.plans import queries as plans

SF = Path("/root/testdata/sf0.001")


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if isinstance(value, (list, tuple)):
        return [_plain(x) for x in value]
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = plans.QUERIES[name](spark, str(SF))
    want = con.execute(plans.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    assert _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows(names, want.fetchall())


def test_mux_clusters_equals_a_loop(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "event_id", "ts", "event_type").collect()]
    want = {}
    for user in {r[0] for r in rows}:
        cluster = start = None
        for _, event, ts, kind in sorted(r for r in rows if r[0] == user):
            ms = int(ts.replace(tzinfo=__import__("datetime").timezone.utc).timestamp() * 1000)
            if cluster is None or kind == "signup" or ms - start > 30_000 or ms < start:
                cluster, start = (-1 if cluster is None else cluster) + 1, ms
            want[user, event] = cluster
    found = {(r.user_id, r.event_id): r.cluster for r in plans.QUERIES["mux_clusters"](spark, str(SF)).collect()}
    assert found == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
