"""Files and folders of any file system that Spark's readers know."""

from __future__ import annotations

import os

from pyarrow import fs
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def is_folder(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where) and system.getFileStatus(where).isDirectory()


def listed(spark: SparkSession, pattern: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of what matches a pattern, in order."""
    system, where = _at(spark, pattern)
    found = system.globStatus(where) or []
    return sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in found)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    return bool(listed(spark, f"{path}/_SUCCESS"))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or a folder with all that it holds."""
    system, where = _at(spark, path)
    system.delete(where, True)


def write_whole(directory: str, name: str, text: str) -> None:
    """A file in a folder that all workers share; a task that runs again leaves the same file."""
    if "://" in directory or directory.startswith("file:"):
        store, base = fs.FileSystem.from_uri(directory)
    else:
        store, base = fs.LocalFileSystem(), os.path.abspath(directory)
    store.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{os.getpid()}"
    with store.open_output_stream(part) as out:
        out.write(text.encode())
    store.move(part, f"{base}/{name}")
