"""Paths in the cluster's file systems, through Hadoop's interface."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _system(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path = _path(spark, name)
    return _system(spark, path).exists(path)


def any_match(spark: SparkSession, pattern: str) -> bool:
    path = _path(spark, pattern)
    return bool(_system(spark, path).globStatus(path))


def make_folder(spark: SparkSession, name: str) -> None:
    path = _path(spark, name)
    _system(spark, path).mkdirs(path)


def write_small(spark: SparkSession, name: str, content: bytes) -> None:
    """One file of a few bytes, replaced if it is there."""
    path = _path(spark, name)
    out = _system(spark, path).create(path, True)
    out.write(bytearray(content))
    out.close()


def move(spark: SparkSession, old: str, new: str) -> bool:
    """Rename, never over something that is there; False if the new name is taken.

    One atomic step where the file system has an atomic rename (HDFS; not a local disk between
    processes).
    """
    source, target = _path(spark, old), _path(spark, new)
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        context.rename(source, target, no_options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def put_in_place(spark: SparkSession, draft: str, name: str) -> None:
    """Give a finished folder its name; a folder that has it goes only after that.

    If the job ends in between, the old folder is still there under ``<name>.old-...``.
    """
    old = None
    make_folder(spark, name.rstrip("/").rpartition("/")[0])
    if exists(spark, name):
        old = f"{name.rstrip('/')}.old-{uuid.uuid4().hex}"
        move(spark, name, old)
    if not move(spark, draft, name):
        raise FileExistsError(name)
    if old:
        path = _path(spark, old)
        _system(spark, path).delete(path, True)
