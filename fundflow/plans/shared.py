"""Tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task of :func:`dealt` is meant to hold.
TASK_ROWS = 1_000_000
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_made: dict[str, object] = {}


def _delete(sc, path: str) -> None:
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _leave_nothing() -> None:
    """Delete what the application has left in the shared folder, on any file
    system, unless the session is gone already."""
    for path, sc in _made.items():
        if sc._jsc is not None:
            with contextlib.suppress(Exception):  # at exit nobody can act on it
                _delete(sc, path)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder of the cluster.

    The folder is read from ``spark.checkpoint.dir`` or the context. A session
    that names none gets one of its own in local mode, as in tests; on a
    cluster that is an error, as executors share no temporary folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        own = tempfile.mkdtemp(prefix="fundflow-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(base := f"file://{own}")
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made[path] = sc
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`shared_dir`."""
    _delete(spark.sparkContext, path)
    _made.pop(path, None)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there,
    and what was written survives the executors that wrote it."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by its keys over as many tasks as keep one to some
    :data:`TASK_ROWS` of ``rows``; tasks aren't merged for being small once
    compressed, as rows of hex digits are."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return df.repartition(parts, *keys)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing will read again; what isn't
    one stays as it is."""
    for df in tables:
        if path := _paths.pop(df, None):
            remove(df.sparkSession, path)
