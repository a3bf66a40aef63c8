"""Places that every executor can read: the folder named in ``spark.checkpoint.dir``."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one only where none is set and Spark runs in this one process (tests).

    On a cluster without a shared folder this fails: each executor would write
    to its own disk, and what others wrote would be missing without an error.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(shared_dir, "own", None)
        if path is None:
            path = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="framelake-")
    return path.rstrip("/")


_stages: ContextVar[tuple[list[str], ...]] = ContextVar("stages", default=())
_lock = threading.Lock()
#: Sessions with lowered settings: how many writes are under way, and the settings before them.
_lowered: dict[int, tuple[int, dict[str, str | None]]] = {}

#: Rows and bytes of a batch that goes to a Python worker while a table is stored; larger settings of the session are lowered to them.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
#: How Parquet tables are read: many ranges at once leave buffers outside the heap with each of the threads that read them.
READ = {"parquet.hadoop.vectored.io.enabled": "false"}


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Whole texts make default batches tens of megabytes large, for each task once in Spark and once in Python; reads are plain.

    Writes of several threads share the lowered settings; the last one to end
    puts the session's own back.
    """
    number = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    with _lock:
        users, before = _lowered.get(id(spark), (0, {}))
        if not users:
            before = {name: spark.conf.get(name) for name in BATCH} | {name: spark.conf.get(name, None) for name in READ}
            for name, value in READ.items():
                spark.conf.set(name, value)
            for name, value in BATCH.items():
                if not 0 < number(before[name]) <= value:
                    spark.conf.set(name, str(value))
        _lowered[id(spark)] = users + 1, before
    try:
        yield
    finally:
        with _lock:
            users, before = _lowered.pop(id(spark))
            if users > 1:
                _lowered[id(spark)] = users - 1, before
            else:
                for name, value in before.items():
                    if value is None:
                        spark.conf.unset(name)
                    else:
                        spark.conf.set(name, value)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing lies under; what is written there goes when a :func:`temporary` around it ends."""
    path = f"{shared_dir(spark)}/framelake/{label}-{uuid.uuid4().hex}"
    for written in _stages.get():
        written.append(path)
    return path


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with ``options`` of the Parquet writer, and read it back.

    Cuts lineage durably: the files outlive any executor, unlike a local
    checkpoint, and row order inside the files is fixed from then on.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with _small_batches(spark):
        df.write.options(**options).parquet(path)
    return spark.read.options(**READ).schema(df.schema).parquet(path)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What this thread materialises inside is deleted in the end; results must be stored or collected by then."""
    written: list[str] = []
    token = _stages.set((*_stages.get(), written))
    try:
        yield
    finally:
        _stages.reset(token)
        for path in written:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can reach it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Files of a table whose ordinals are broadcast; those of more files are joined.
MOST_FILES = 100_000


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with __row, a number for each row: its file's ordinal above bit 33, its place in that file below.

    Unlike ``monotonically_increasing_id`` the number does not depend on how
    files are split, which hangs on the cores alive at the time of a scan, so
    separate scans of a stored table agree.  What is no Parquet table is stored
    first, so operators call this once, before their first scan; a table that has
    its numbers stays as it is; another column of that name is left out.
    """
    own = [c for c in df.columns if c.lower() == "__row"]
    if own == ["__row"] and df.schema["__row"].metadata.get("framelake") == "row":
        return df
    df = df.drop(*own)
    place = lambda df: df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    try:
        placed = place(df)
    except AnalysisException:
        df = materialise(df, "numbered")
        placed = place(df)
    # one row for each file, whatever the number of rows
    paths = sorted(r[0] for r in placed.select("__file").distinct().collect())
    files = df.sparkSession.createDataFrame([(path, k) for k, path in enumerate(paths)], "__file string, __ordinal long")
    number = F.shiftleft(F.col("__ordinal"), 33) + F.col("__place")
    files = F.broadcast(files) if len(paths) <= MOST_FILES else files
    return placed.join(files, "__file").select(*df.columns, number.alias("__row", metadata={"framelake": "row"}))
