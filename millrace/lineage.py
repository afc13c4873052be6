"""Intermediate tables that several branches or rounds of a plan read.

They are written to the shared folder that the cluster names in ``spark.checkpoint.dir``, so that losing an executor costs
a re-read and not a recomputation of the whole lineage. A folder of our own is made only where the setting is absent and
the session is local.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "millrace-"
_own: dict[str, str] = {}
_written: set[tuple[SparkSession, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix=_PREFIX)
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, to be removed with the tables of :func:`materialize`."""
    path = f"{shared_dir(spark)}/{_PREFIX}{uuid.uuid4().hex}"
    _written.add((spark, path))
    return path


def materialize(df: DataFrame, folders_by: str | None = None) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder, and read back; with a folder for each value of a column.

    Parquet keeps the table far smaller than a serialized-row checkpoint, and readers prune columns of it. Hand the
    result to :func:`discard` as soon as nothing reads it any more, or work in a :func:`scope`; what is left is removed
    when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(folders_by) if folders_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path  # type: ignore[attr-defined]
    return out


@contextmanager
def scope() -> Iterator[None]:
    """Removes at its end the intermediate tables written inside; results must have been read or written by then."""
    before = set(_written)
    try:
        yield
    finally:
        for spark, path in _written - before:
            _remove(spark, path)


def sweep(spark: SparkSession, hours: float = 48) -> int:
    """Remove intermediate tables of drivers that were killed: those in the shared folder not touched for some hours."""
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    old = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith(_PREFIX) and f.getModificationTime() < (time.time() - hours * 3600) * 1000]
    for path in old:
        fs.delete(path, True)
    return len(old)


def discard(df: DataFrame | None) -> None:
    """Remove a table of :func:`materialize` that no plan reads any more."""
    path = getattr(df, "_millrace_path", None)
    if path is not None:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    _written.discard((spark, path))
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already; a shared folder has its own cleaning
        pass


@atexit.register
def _at_exit() -> None:
    for spark, path in list(_written):
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        elif spark.sparkContext._jsc is not None:
            _remove(spark, path)
