"""Small files and the ends of large ones, on any storage that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, path: str, suffix: str) -> list[tuple[str, int]]:
    """``path, bytes`` of the files below a folder (or of the one file) that aren't hidden."""
    p, fs = _path(spark, path)
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        name = f.getPath().getName()
        if name.endswith(suffix) and not name.startswith(("_", ".")) or f.getPath().equals(fs.makeQualified(p)):
            found.append((f.getPath().toString(), f.getLen()))
    return sorted(found)


def read_bytes(spark: SparkSession, path: str, start: int = 0, size: int | None = None) -> bytes:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        stream.seek(start)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size if size is not None else fs.getFileStatus(p).getLen() - start))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    p, fs = _path(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(data)
    finally:
        stream.close()
