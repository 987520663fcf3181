"""Folders of a Hadoop file system, as the driver lists, writes and deletes them (a few calls, never per row)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> dict[str, str]:
    """Names and places of the folders right under ``path`` (none if there is no such path)."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return {}
    return {x.getPath().getName(): x.getPath().toString() for x in fs.listStatus(p) if x.isDirectory()}


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written whole or (if the driver dies) not under its name."""
    p, fs = _path(spark, path)
    part, _ = _path(spark, f"{path}.tmp")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(part, p)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move a file, replacing one that is there."""
    p, fs = _path(spark, old)
    to, _ = _path(spark, new)
    fs.mkdirs(to.getParent())
    fs.delete(to, False)
    fs.rename(p, to)


def files(spark: SparkSession, path: str) -> dict[str, str]:
    """Names and places of the files right under ``path``."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return {}
    return {x.getPath().getName(): x.getPath().toString() for x in fs.listStatus(p) if x.isFile()}
