"""Shared storage for intermediate results that several jobs read."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_OPEN: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Where that setting is absent a temporary folder serves, but only if driver and tasks are one
    process (master local); on a cluster it is an error, as each machine would write to its own disk.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what stands above, and several
    consumers read the rows instead of computing them again.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later job reads; other frames are passed over."""
    for df in tables:
        path = getattr(df, "_table", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            del df._table


@contextmanager
def scratch():
    """Tables materialized within are deleted at the end, when what was made from them must be written."""
    _OPEN.append([])
    try:
        yield
    finally:
        discard(*_OPEN.pop())
