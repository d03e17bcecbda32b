"""Folders and code that the driver and all executors share."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import time
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_ROOTS: dict[str, str] = {}


#: Bytes of an Arrow batch that goes to a Python worker: a worker holds a few of them, however long single texts are on average.
BATCH_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it, and bound Arrow batches by bytes."""
    app = spark.sparkContext.applicationId
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ballast-"), "ballast.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("ballast", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


#: What clears the caches that Python workers keep between tasks; operators add to it.
CACHES: list = []


def make_room(but: object = None) -> None:
    """In a Python worker, at the start of a task: drop what tasks of other operators (all but the cache `but`) have left, and give freed memory back."""
    for clear in CACHES:
        if clear is not but:
            clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library: it keeps what it likes
        pass


def _hadoop_path(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir. Only in local mode a temporary folder is used where that is unset; elsewhere that raises, as executors don't share such a folder."""
    sc = spark.sparkContext
    root = _ROOTS.get(sc.applicationId)
    if root is None:
        root = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
        if not root:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="ballast-checkpoint-")
            sc.setCheckpointDir(root)
        elif sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(root)
        root = f"{root.rstrip('/')}/ballast-{uuid.uuid4().hex}"
        _ROOTS[sc.applicationId] = root

        def clean() -> None:
            try:
                fs, path = _hadoop_path(spark, root)
                fs.delete(path, True)
            except Exception:  # the session has ended already  # noqa: BLE001
                pass

        atexit.register(clean)
    return f"{root}/{uuid.uuid4().hex}"


#: Bytes that a file of a written table should have.
FILE_BYTES = 32 << 20


def compact(df: DataFrame, rows_are_small: bool = False) -> DataFrame:
    """df in at most four partitions a core, or one for each FILE_BYTES that Spark expects if that is more.

    So a small table doesn't end up as very many files. Each file costs processes: where Hadoop's native code is missing, a
    JVM forks one to set a file's mode, and until that one runs its own program the JVM's memory counts twice.
    rows_are_small: rows are a few numbers, and what Spark expects (the product of a join's sides) isn't asked. Make a scan
    compact before Python reads it, not after: what a task has exchanged with Python for several partitions is freed at its end.
    """
    n = 4 * df.sparkSession.sparkContext.defaultParallelism
    if not rows_are_small:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        n = max(n, size // FILE_BYTES)
    return df.coalesce(min(n, 2**31 - 1))


def stored(df: DataFrame, rows_are_small: bool = False, as_it_is: bool = False, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, and survives lost executors.

    as_it_is: don't make it compact, because its rows hold the number of the task that makes them.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    (df if as_it_is else compact(df, rows_are_small)).write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of what has been written and isn't referred to any more; else they stay until the driver happens to collect garbage.

    The first collection frees the finished query, whose stages then are what the second one frees.
    """
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def discard(df: DataFrame) -> None:
    """Delete what `stored` has written for this very DataFrame, once its successor is written."""
    fs, path = _hadoop_path(df.sparkSession, df.stored_at)
    fs.delete(path, True)
