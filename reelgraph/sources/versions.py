"""Sets of tables that change all at once: readers see the old version or the new, whatever fails in between.

A version is a folder of Parquet tables under the root. Which one holds is told by a small file, which
is replaced by one atomic rename after all tables of the new version stand. So a new version may be made
from the tables that it replaces, a job that dies half-way leaves what readers see untouched, and a
lost executor can read again what it needs. One writer at a time; the version before stays for readers
that still hold it, and older folders, those of failed writes too, go at the next switch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_POINTER = "_current"


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> list[str]:
    """Names of the version that holds and, if there is one, of that before it; none where nothing was written."""
    path, fs = _fs(spark, root)
    at = path(f"{root}/{_POINTER}")
    return _text(spark, fs, at).split() if fs.exists(at) else []


def _text(spark: SparkSession, fs, at) -> str:
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Texts of the small files in a folder by name, those that begin with a dot left out; none where there is no folder."""
    path, fs = _fs(spark, folder)
    at = path(folder)
    found = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
    return {f.getName(): _text(spark, fs, f) for f in found if not f.getName().startswith(".")}


def replace_file(spark: SparkSession, target: str, text: str) -> None:
    """Make target a file of that text by one atomic rename: readers find the old text or the new."""
    path, fs = _fs(spark, target)
    folder, name = target.rsplit("/", 1)
    new = path(f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    rename = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.FileContext.getFileContext(path(folder).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(path(target)), options)


def read(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A table of the version that holds; None where nothing was written."""
    now = current(spark, root)
    return spark.read.parquet(f"{root}/{now[0]}/{name}") if now else None


def write(root: str, tables: dict[str, DataFrame]) -> str:
    """Write a version with these tables and switch to it; its name."""
    spark = next(iter(tables.values())).sparkSession
    path, fs = _fs(spark, root)
    name, before = f"v-{uuid.uuid4().hex}", current(spark, root)[:1]
    for table, rows in tables.items():
        rows.write.parquet(f"{root}/{name}/{table}")
    replace_file(spark, f"{root}/{_POINTER}", "\n".join([name, *before]))
    for found in fs.listStatus(path(root)):
        if found.getPath().getName().startswith("v-") and found.getPath().getName() not in (name, *before):
            fs.delete(found.getPath(), True)
    return name
