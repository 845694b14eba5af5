"""Small marker files with names of their own: created whole and only once, so that of two writers one finds out that it lost.

On a mounted file system a marker is written beside its place and linked to it, which the kernel does for one writer only; elsewhere the
file system's own create without overwriting decides (HDFS and object stores with conditional writes do).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a marker that does not exist; False if it does."""
    p, fs = _fs(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getScheme() == "file":
        local = p.toUri().getPath()
        own = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
        with open(own, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(own, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    if fs.exists(p):
        return False
    try:
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()
    except Exception as e:  # the JVM's error of a file that is there
        if "AlreadyExists" in str(e):
            return False
        raise
    return True


def read(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's entries in order, hidden ones left out; none if there is no folder."""
    p, fs = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(n for f in fs.listStatus(p) if not (n := f.getPath().getName()).startswith((".", "_")))


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def size(spark: SparkSession, folder: str) -> int:
    """Bytes of a folder."""
    p, fs = _fs(spark, folder)
    return fs.getContentSummary(p).getLength()


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p, fs = _fs(spark, path)
        fs.delete(p, True)
