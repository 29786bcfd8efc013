"""A table that streams append to by epochs: a repeated or half-written epoch leaves it as one clean run would.

An epoch is a folder of its own under its stream, cut by a hash of the key. It counts once the stream's
mark, a small file replaced by one atomic rename, names it; readers pass over later ones. So a killed
epoch is invisible, and its repetition overwrites what it left.

A stream of many epochs is folded from time to time: the rows of all its epochs so far go to one folder,
and the mark switches to that folder and the epochs after it. Readers see the epochs or the fold, whenever
it dies. What a fold replaces stays for readers that hold it until the next fold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from reelgraph.runtime import discard, materialize
from reelgraph.sources import sinks, versions

_MARKS = "_marks"


def marks(spark: SparkSession, root: str) -> dict[str, int]:
    """The last epoch that counts, by stream."""
    return {name: last for name, (last, _) in _marks(spark, root).items()}


def _marks(spark: SparkSession, root: str) -> dict[str, tuple[int, int]]:
    """(last epoch that counts, last epoch that is folded or -1), by stream."""
    found = {name: text.split() for name, text in versions.read_files(spark, f"{root}/{_MARKS}").items()}
    return {name: (int(last), int(folded[0]) if folded else -1) for name, (last, *folded) in found.items()}


def _set_mark(spark: SparkSession, root: str, stream: str, last: int, folded: int) -> None:
    versions.replace_file(spark, f"{root}/{_MARKS}/{stream}", f"{last} {folded}")


def _fold_of(epoch: int) -> int:
    """The number under which the fold of all epochs up to this one stands; below zero, so no epoch has it."""
    return -1 - epoch


def read(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """Rows of all epochs that count; none where no stream has written."""
    return _rows(spark, root, schema, None).select(*schema.names)


def append(root: str, keys: list[str], order: list[str], stream: str, buckets: int = 64, fold_every: int | None = None):
    """A sink for foreachBatch: of each batch, the first row (by order) of every key that the table lacks.

    A batch meets only the buckets that its keys fall into. Streams that write to one table need names of
    their own, and so does a stream that begins again with a new checkpoint: an epoch before the mark is an
    error, the marked one is passed over. One batch writes at a time. Rows with a null in the key are never
    in the table already, as in a unique index. The number of buckets must stay. With fold_every, the
    stream is folded whenever so many epochs stand beside its fold.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last, folded = _marks(spark, root).get(stream, (-1, -1))
        if epoch == last:
            return
        if epoch < last:
            raise ValueError(f"stream {stream} has written epoch {last}; give one that begins again a new name")
        rows = materialize(batch.withColumn("_bucket", _bucket(keys, buckets)), "batch")
        touched = [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]
        known = _rows(spark, root, batch.schema, touched)
        new = sinks.insert_ignore(known, rows, keys, order)
        new.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/_stream={stream}/_epoch={epoch}")
        _set_mark(spark, root, stream, epoch, folded)
        discard(rows)
        if fold_every and epoch - folded >= fold_every:
            fold(spark, root, stream, batch.schema)

    return sink


def fold(spark: SparkSession, root: str, stream: str, schema: StructType) -> None:
    """Bring all epochs of a stream that count into one folder. Not while a batch is written; nothing happens if all are folded."""
    last, folded = _marks(spark, root).get(stream, (-1, -1))
    if last == folded:
        return
    path, folder = spark._jvm.org.apache.hadoop.fs.Path, f"{root}/_stream={stream}"
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    there = {int(f.getPath().getName().removeprefix("_epoch=")): f.getPath() for f in fs.listStatus(path(folder)) if f.getPath().getName().startswith("_epoch=")}
    rows = _rows(spark, root, schema, None).where(F.col("_stream") == stream).select(*schema.names, "_bucket")
    rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/_epoch={_fold_of(last)}")
    _set_mark(spark, root, stream, last, last)
    for epoch, at in there.items():  # what the fold before had replaced, and folds that died
        if 0 <= epoch <= folded or epoch < 0 and epoch not in (_fold_of(folded), _fold_of(last)):
            fs.delete(at, True)


def _counts(last: int, folded: int) -> Column:
    epoch = F.col("_epoch")
    since = (epoch > folded) & (epoch >= 0) & (epoch <= last)
    return since | (epoch == _fold_of(folded)) if folded >= 0 else since


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, root: str, schema: StructType, touched: list[int] | None) -> DataFrame:
    """Rows that count, of the touched buckets if given; streams, epochs and buckets are partitions, so the others are not read."""
    done = _marks(spark, root)
    if not done:
        return spark.createDataFrame([], schema)
    full = StructType(schema.fields + StructType().add("_stream", StringType()).add("_epoch", LongType()).add("_bucket", IntegerType()).fields)
    counts = reduce(lambda a, b: a | b, [(F.col("_stream") == s) & _counts(last, folded) for s, (last, folded) in done.items()])
    rows = spark.read.schema(full).parquet(root).where(counts)
    return rows if touched is None else rows.where(F.col("_bucket").isin(touched))
