"""Streams that append by epochs, killed and repeated."""

from datetime import datetime

import pytest

from reelgraph.sources import versions
from reelgraph.streaming import epochs, incremental

SCHEMA = "account_id long, external_id string, at timestamp"
KEYS = ["account_id", "external_id"]


def at(d):
    return datetime(2024, 1, d)


def keys(df):
    return sorted((r["account_id"], r["external_id"], r["at"].day) for r in df.collect())


def test_killed_epoch_adds_nothing_twice(spark, tmp_path, monkeypatch):
    feed, root = str(tmp_path / "feed"), str(tmp_path / "table")
    schema = spark.createDataFrame([], SCHEMA).schema

    def run():
        posts = incremental.ingest_stream(spark.readStream.schema(schema).parquet(feed), "at")
        sink = epochs.append(root, KEYS, ["at"], "feed", buckets=8)
        posts.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)

    land([(1, "a", at(1)), (1, "a", at(1)), (1, "b", at(2)), (2, "a", at(2))])
    assert epochs.read(spark, root, schema).isEmpty()
    with monkeypatch.context() as m:
        m.setattr(versions, "replace_file", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(Exception, match="killed"):
            run()
    assert epochs.read(spark, root, schema).isEmpty() and (tmp_path / "table" / "_stream=feed").exists()
    run()
    first = [(1, "a", 1), (1, "b", 2), (2, "a", 2)]
    assert keys(epochs.read(spark, root, schema)) == first
    land([(1, "b", at(9)), (3, "c", at(9))])
    run()
    assert keys(epochs.read(spark, root, schema)) == [*first, (3, "c", 9)]
    last = epochs.marks(spark, root)["feed"]
    again = spark.createDataFrame([(7, "z", at(1))], schema)
    epochs.append(root, KEYS, ["at"], "feed", buckets=8)(again, last)
    assert keys(epochs.read(spark, root, schema)) == [*first, (3, "c", 9)]


def test_names_nulls_and_buckets(spark, tmp_path):
    root = str(tmp_path / "table")
    schema = spark.createDataFrame([], SCHEMA).schema
    one, two = epochs.append(root, KEYS, ["at"], "one", 8), epochs.append(root, KEYS, ["at"], "two", 8)
    rows = spark.createDataFrame([(i, "x", at(1)) for i in range(40)] + [(None, "x", at(1))], schema)
    one(rows, 0)
    one(spark.createDataFrame([], schema), 1)
    two(spark.createDataFrame([(3, "x", at(2)), (3, "y", at(3)), (3, "y", at(2)), (None, "x", at(2))], schema), 0)
    found = epochs.read(spark, root, schema)
    assert found.count() == 43 and found.where("external_id = 'y'").first()["at"] == at(2) and found.where("account_id IS NULL").count() == 2
    with pytest.raises(ValueError, match="new name"):
        one(rows, 0)
    with_bucket = rows.where("account_id = 3").withColumn("_bucket", epochs._bucket(KEYS, 8))
    touched = [with_bucket.first()["_bucket"]]
    scan = epochs._rows(spark, root, schema, touched)
    whole = epochs._rows(spark, root, schema, None)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert 0 < scan.count() < whole.count()


def test_folds(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "table")
    schema = spark.createDataFrame([], SCHEMA).schema
    folders = lambda: sorted(int(p.name.split("=")[1]) for p in (tmp_path / "table" / "_stream=s").glob("_epoch=*"))
    batch = lambda *ids: spark.createDataFrame([(i, "x", at(1)) for i in ids], schema)
    sink = epochs.append(root, KEYS, ["at"], "s", buckets=2)
    for n in range(3):
        sink(batch(n, n + 1), n)  # each meets a key of the one before
    want = [(i, "x", 1) for i in range(4)]
    with monkeypatch.context() as m:  # a fold that dies before its mark
        m.setattr(versions, "replace_file", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            epochs.fold(spark, root, "s", schema)
    assert keys(epochs.read(spark, root, schema)) == want and folders() == [-3, 0, 1, 2]
    before = epochs.read(spark, root, schema)
    epochs.fold(spark, root, "s", schema)
    assert keys(epochs.read(spark, root, schema)) == want and epochs.marks(spark, root) == {"s": 2}
    assert keys(before) == want  # one who read the epochs still can
    epochs.fold(spark, root, "s", schema)  # nothing new
    sink(batch(99), 2)  # repeated
    with pytest.raises(ValueError, match="new name"):
        sink(batch(99), 1)
    sink(batch(0, 7), 3)
    assert keys(epochs.read(spark, root, schema)) == [*want, (7, "x", 1)]
    sink = epochs.append(root, KEYS, ["at"], "s", buckets=2, fold_every=2)
    sink(batch(7, 8), 4)  # the second since the fold
    assert keys(epochs.read(spark, root, schema)) == [*want, (7, "x", 1), (8, "x", 1)]
    assert folders() == [-5, -3, 3, 4]
    epochs.append(root, KEYS, ["at"], "other", buckets=2)(batch(8, 9), 0)  # meets the fold of another stream
    assert epochs.read(spark, root, schema).count() == 7
    epochs.fold(spark, root, "none", schema)
