"""Files on whatever store the paths name, through Spark's own file systems: tests, bytes, listings, exclusive writes."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def get(spark: SparkSession, path: str) -> bytes:
    """A small file's bytes; FileNotFoundError if there is none."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file, in place of one that is there."""
    fs, where = _at(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, data: bytes) -> bool:
    """Write a small file under a name that nobody has yet: whole or not at all, and False if somebody was first."""
    fs, where = _at(spark, path)
    if fs.exists(where):
        return False
    if fs.getUri().getScheme() == "file":
        return _link_new(fs.makeQualified(where).toUri().getPath(), data)
    draft = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    put(spark, draft, data)
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(draft), where, plain)
    except Py4JJavaError as error:
        delete(spark, draft)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def _link_new(path: str, data: bytes) -> bool:
    """put_new on a local disk: Hadoop's rename looks and then replaces, in two steps and once more for the checksum, so
    two writers can both be first; a link is made in one step or not at all, and has no checksum file."""
    folder = os.path.dirname(path)
    os.makedirs(folder, exist_ok=True)
    draft = f"{folder}/.{uuid.uuid4().hex}"
    try:
        with open(draft, "xb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        os.link(draft, path)
    except FileExistsError:
        return False
    finally:
        if os.path.exists(draft):
            os.unlink(draft)
    return True


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder; it's an error if that isn't possible."""
    fs, where = _at(spark, path)
    fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(to).getParent())
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} can't be renamed to {to}")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no folder. Reads no file."""
    fs, where = _at(spark, path)
    return sorted(found.getPath().getName() for found in fs.listStatus(where)) if fs.exists(where) else []
