"""Folder listing on the cluster's file system (metadata only, no data read)."""

from __future__ import annotations

import posixpath
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class FileExists(RuntimeError):
    """Another writer has made this file."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def child_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders of ``path`` (empty when it does not exist)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]


def path_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files under ``path`` (file-system metadata only)."""
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def delete(spark: SparkSession, path: str) -> bool:
    """Delete ``path`` and all below it; False if there was nothing."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p) and fs.delete(p, True))


def child_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly below ``path`` (empty when it does not exist)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isFile()]


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's whole text."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return str(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that nobody has written yet, else FileExists.

    The text goes to a name of its own first and is renamed without
    overwriting, so a reader never sees a part of it.
    """
    fs, p = _fs(spark, path)
    folder, name = posixpath.split(path)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    mine = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = fs.create(mine, False)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    plain = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(mine), fs.makeQualified(p), plain)
    except Py4JJavaError as exc:
        fs.delete(mine, False)
        if "FileAlreadyExists" in exc.java_exception.getClass().getSimpleName():
            raise FileExists(path) from None
        raise
