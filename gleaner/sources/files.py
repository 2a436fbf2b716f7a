"""Small files in shared storage that appear whole or not at all."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """Hadoop's path and the file system that holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text`` in one step; False, and no change, where it exists.

    The text is written beside it under a name that readers pass over and then
    renamed, which file systems with an atomic rename grant to one writer alone.
    """
    at, fs = _at(spark, path)
    if fs.exists(at):
        return False
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs.mkdirs(at.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{at.getName()}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    how = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(at), how)
    except Py4JJavaError as e:
        fs.delete(beside, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def text_of(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None where there is none."""
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder, sorted, without those that readers pass over."""
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return []
    return sorted(n for s in fs.listStatus(at) if (n := s.getPath().getName())[0] not in "_.")


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)
