"""What a store's catalog and its advisory locks are asked for: is a table there, and may I set up tables alone.

A lock is a file that only one process can create. Local file systems and HDFS
keep that promise; plain object stores do not.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(context._jsc.hadoopConfiguration())


def is_there(spark: SparkSession, table: str) -> bool:
    """Whether a table of the catalog or, if it holds a slash, a folder or file exists."""
    if "/" not in table:
        return spark.catalog.tableExists(table)
    at, files = _place(spark, table)
    return files.exists(at)


def _created(at, files) -> bool:
    """Whether this call made the file. Spark's local file system looks before it creates, so the operating system is asked there."""
    if files.getUri().getScheme() == "file":
        try:
            os.close(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        return files.createNewFile(at)
    except Py4JJavaError:
        # two at once: one is told so by an error
        if files.exists(at):
            return False
        raise


@contextmanager
def alone(spark: SparkSession, folder: str, name: str, *, patience: float = 60.0, step: float = 0.1, wait: Callable[[float], None] = time.sleep) -> Iterator[None]:
    """Holds the lock name in folder, which all processes share, for the block.

    Raises TimeoutError if another holds it for patience seconds. A process that
    dies leaves its file, which is then for a person to remove: nothing here can
    tell a dead holder from a slow one.
    """
    at, files = _place(spark, f"{folder}/{name}.lock")
    files.mkdirs(at.getParent())
    waited = 0.0
    while not _created(at, files):
        if waited >= patience:
            raise TimeoutError(f"{at.toString()} is held by another process")
        wait(step)
        waited += step
    try:
        yield
    finally:
        files.delete(at, False)
