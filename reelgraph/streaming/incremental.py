"""Incremental work as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reelgraph.operators import terms, vectors
from reelgraph.sources import sinks


def route_stream(posts: DataFrame, worlds: DataFrame, post_id: str, vector: str, sink, checkpoint: str):
    """Route posts as they arrive; sink(batch, epoch) upserts, and a repeated epoch must change nothing."""
    routed = vectors.route(posts, worlds, post_id, vector)
    return routed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(posts: DataFrame, at: str, delay: str = "1 day") -> DataFrame:
    """The first of each (account_id, external_id) within the delay; older repeats meet the table in the sink."""
    return posts.withWatermark(at, delay).dropDuplicatesWithinWatermark(["account_id", "external_id"])


def append_new(table_path: str, keys: list[str], order: list[str]):
    """A sink for foreachBatch: rows whose key the Parquet table lacks are appended. A repeated epoch finds its rows there and appends none."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        table = spark.read.schema(batch.schema).parquet(table_path)
        sinks.insert_ignore(table, batch, keys, order).write.mode("append").parquet(table_path)

    return sink


def term_stream(posts: DataFrame, **options) -> DataFrame:
    """Term edges on arrival, stateless; a term that a post repeats is repeated, and the sink keeps the first."""
    return terms.extract_terms(posts, dedupe=False, **options)
