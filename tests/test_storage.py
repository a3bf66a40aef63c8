"""The shared folder: where it is, what is deleted from it, and numbers of rows."""

from __future__ import annotations

import threading
from pathlib import Path
from types import SimpleNamespace

import pytest

from framelake import storage


def test_temporary_tables_are_deleted(spark):
    with storage.temporary(spark):
        found = storage.materialise(spark.range(10).toDF("x"), "gone")
        folders = {Path(f.removeprefix("file:")).parent for f in found.inputFiles()}
        assert found.count() == 10 and all(f.exists() for f in folders)
    assert folders and not any(f.exists() for f in folders)
    kept = storage.materialise(spark.range(3).toDF("x"), "kept")
    assert kept.count() == 3


def test_a_cluster_without_a_shared_folder_fails():
    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda *_: None), getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        storage.shared_dir(SimpleNamespace(sparkContext=context))
    context.getCheckpointDir = lambda: "hdfs://shared/folder/"
    assert storage.shared_dir(SimpleNamespace(sparkContext=context)) == "hdfs://shared/folder"


def test_a_column_of_the_same_name_is_no_number(spark, tmp_path):
    spark.range(5).selectExpr("id", "id * 2 AS __row").write.parquet(f"{tmp_path}/t")
    found = storage.numbered(spark.read.parquet(f"{tmp_path}/t"))
    assert storage.numbered(found) is found
    assert len({r["__row"] for r in found.collect()}) == 5 and found.columns == ["id", "__row"]


def test_batches_are_smaller_while_a_table_is_stored(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for setting, most in (("10000", 2000), ("0", 2000), ("300", 300)):
        spark.conf.set(name, setting)
        found = storage.materialise(spark.range(9000).coalesce(1).mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "id long"), "batches")
        assert found.count() == -(-9000 // most) and spark.conf.get(name) == setting
    spark.conf.unset(name)


def test_tables_are_read_in_one_range_at_a_time_while_a_table_is_stored(spark):
    name = "parquet.hadoop.vectored.io.enabled"
    with storage._small_batches(spark):
        assert spark.conf.get(name) == "false"
    assert spark.conf.get(name, None) is None
    spark.conf.set(name, "true")
    assert storage.materialise(spark.range(3), "plain").count() == 3 and spark.conf.get(name) == "true"
    spark.conf.unset(name)


def test_threads_delete_their_own_tables_only(spark):
    made, inside, leave = {}, threading.Event(), threading.Event()

    def other():
        with storage.temporary(spark):
            made["other"] = storage.materialise(spark.range(4).toDF("x"), "other")
            inside.set()
            leave.wait(60)
            made["count"] = made["other"].count()

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    with storage.temporary(spark):
        storage.materialise(spark.range(2).toDF("x"), "mine").count()
    leave.set()
    thread.join()
    assert made["count"] == 4
    assert not any(Path(f.removeprefix("file:")).exists() for f in made["other"].inputFiles())
