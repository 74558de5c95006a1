"""Versioned table folders: every overwrite is a new version, published by one pointer switched last.

``T/version=<id>/...`` holds the files of a version, ``T/_current`` the id of the published one. A
write that fails on the way leaves the pointer, and with it the old table, as it was. The pointer is
replaced by a single rename, so a reader sees the old version or the new one. The version published
before stays until the next overwrite, for readers that have already resolved it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession

POINTER = "_current"
VERSION = "version="


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def published(spark: SparkSession, path: str) -> str | None:
    """The id of the table's published version; None if it has none."""
    fs, p, jvm = _fs(spark, path)
    at = jvm.org.apache.hadoop.fs.Path(p, POINTER)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()


def resolve_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the published version; None for a folder without versions."""
    name = published(spark, path)
    return f"{path.rstrip('/')}/{VERSION}{name}" if name else None


def new_version() -> str:
    """Ids that sort by time."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def publish(spark: SparkSession, path: str, name: str) -> None:
    """Make ``name`` the table's version, then remove all but it and its predecessor."""
    fs, p, jvm = _fs(spark, path)
    before = published(spark, path)
    path_of = jvm.org.apache.hadoop.fs.Path
    draft, pointer = path_of(p, f"{POINTER}.{uuid.uuid4().hex[:8]}"), path_of(p, POINTER)
    out = fs.create(draft, True)
    try:
        out.write(name.encode())
    finally:
        out.close()
    gateway = spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()) \
        .rename(fs.makeQualified(draft), fs.makeQualified(pointer), how)
    for st in fs.listStatus(p):
        found = st.getPath().getName()
        if found.startswith(VERSION) and found[len(VERSION):] not in (name, before):
            fs.delete(st.getPath(), True)
        elif before is None and not found.startswith((VERSION, POINTER)):
            fs.delete(st.getPath(), True)  # files of the time before the folder had versions


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there."""
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)
