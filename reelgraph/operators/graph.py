"""Connected components of an edge table, by alternating stars, and spanning forests within a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgraph.runtime import discard, materialize

#: As many edges fit one task with room to spare.
FEW = 100_000


def forest(n: int, pairs) -> np.ndarray:
    """Parents (each at most the node itself) of n nodes after joining all pairs of index arrays."""
    parent = np.arange(n)
    for a, b in pairs:
        join_pairs(parent, a, b)
    return parent


def join_pairs(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join pairs of nodes in place; a parent is the least node of what hangs together."""
    while True:
        x, y = parent[a], parent[b]
        if (x == y).all():
            return
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _finish(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (u, v) that fit one task, which reads the nodes in Spark's order of them."""
    kind = edges.schema["u"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])

    def run(batches):
        place, nodes, ends = {}, [], []
        key = lambda x: tuple(x.values()) if isinstance(x, dict) else x
        for batch in batches:
            us, first = [key(x) for x in batch.column(0).to_pylist()], []
            for i, u in enumerate(us):
                if u not in place:
                    place[u] = len(place)
                    first.append(i)
            nodes.append(batch.column(0).take(pa.array(first, pa.int64())))
            ends += zip(us, map(key, batch.column(1).to_pylist()), strict=True)
        if ends:
            a, b = (np.array([place[e[side]] for e in ends]) for side in (0, 1))
            nodes = pa.concat_arrays(nodes)
            yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(forest(len(place), [(a, b)])))], ["node", "component"])

    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.repartition(1).sortWithinPartitions("u").mapInArrow(run, schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", few: int = 0) -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest node.

    Large-star and small-star rounds alternate until the edge set stands still. Each round joins a
    per-node minimum (partially aggregated before its shuffle) back to the edges, so a hub is never
    gathered in one task: AQE may split its side of the join. Edges never grow in number, and a
    round's tables are deleted when the next stand. As soon as no more than `few` edges are left, one
    task finishes them, to the same components. Nodes are plain values or structs of such. Self links
    and rows with a null end give no edge; repeated edges count once; no edges, no rows.
    """
    u, v = F.col(src), F.col(dst)
    now = materialize(
        edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(),
        "cc",
    )
    state = _state(now)
    while state[0]:
        if state[0] <= few:
            # contracted edges still hold every node, each in its component
            out = materialize(_finish(now), "cc")
            discard(now)
            return out
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(before, large)
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
