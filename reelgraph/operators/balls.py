"""Blocks of near vectors, and which vectors of one block can reach another.

Vectors go to the nearest of some pivots, a sample of the group by hash; a cell of more than BLOCK
vectors is split. A block is a ball about its pivot. A vector has a neighbour within r in a block only
if it lies within r of that ball, so only such vectors are copied to the pair of blocks, and a pair
whose balls are further apart is never made. What is left out holds no link, by the triangle inequality.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reelgraph.runtime import materialize

#: Rows that meet all pivots of their group in one task, and pivots of a group, about.
PART, PIVOTS = 10_000, 4096
#: Distances that a task holds at once.
HELD = 2_000_000
#: What distances may be off, in floating point.
SLACK = 1e-6


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _slices(rows: int, others: int) -> list[slice]:
    """Slices of rows whose distances to all others are about HELD numbers."""
    step = max(1, HELD // max(1, others))
    return [slice(i, i + step) for i in range(0, rows, step)]


def _with_all(rows: DataFrame, others: DataFrame, sizes: DataFrame, by: list[str], values: list[str], fn, schema: T.StructType) -> DataFrame:
    """fn(rows, others of their group) of parts of about PART rows (by.., id, ..) each; values names the columns of others."""
    parts = F.ceil(F.col("n") / F.lit(PART)).cast("int")
    dealt = rows.join(sizes.select(*by, "n"), by).withColumn("_part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("n")
    copies = others.join(sizes.select(*by, "n"), by).select(*by, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), *values)

    def run(rows: pa.Table, others: pa.Table) -> pa.Table:
        out = to_arrow_schema(schema)
        if not rows.num_rows:
            return out.empty_table()
        return fn(rows, others, out)

    return dealt.groupBy(*by, "_part").cogroup(copies.groupBy(*by, "_part")).applyInArrow(run, schema)


def near_blocks(rows: DataFrame, by: list[str], reach: float, block: int) -> DataFrame:
    """(by.., id, v, own, lo, hi): each row of rows (by.., id, v) once for each pair (lo, hi) of blocks, its own among them, in which it may lie within `reach` of a row of the other.

    A row stands with its own block alone (lo = hi) too. v is not null, and of one size in a group. A
    group of at most `block` rows is one block.
    """
    rows = rows.select(*by, "id", "v")
    sizes = materialize(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "sizes")
    zero = F.lit(0).cast("long")
    small = rows.join(sizes.where(F.col("n") <= block), by).select(*by, "id", "v", zero.alias("own"), zero.alias("lo"), zero.alias("hi"))
    if sizes.where(F.col("n") > block).isEmpty():
        return small
    large = sizes.where(F.col("n") > block)
    some = rows.join(large, by)
    every = F.greatest(F.lit(block), F.ceil(F.col("n") / F.lit(PIVOTS))).cast("long")
    pivots = materialize(some.where(F.pmod(F.xxhash64("id", F.lit("pivot")), every) == 0).select(*by, F.xxhash64("id").alias("cell"), F.col("v").alias("c")), "pivots")
    kind = lambda df, names: [df.schema[c] for c in names]
    long, double = T.LongType(), T.DoubleType()

    def nearest(rows: pa.Table, pivots: pa.Table, out: pa.Schema) -> pa.Table:
        x = _matrix(rows.column("v"))
        if pivots.num_rows:
            pivots = pivots.sort_by("cell")
            c, at, far = _matrix(pivots.column("c")), np.zeros(len(x), np.int64), np.zeros(len(x))
            for some in _slices(len(x), len(c)):
                d = _distances(x[some], c)
                at[some] = d.argmin(axis=1)
                far[some] = d[np.arange(len(d)), at[some]]
            cell = pivots.column("cell").to_numpy()[at]
        else:  # no pivot: one cell about the origin
            cell, far = np.zeros(len(x), np.int64), np.linalg.norm(x, axis=1)
        return pa.table([*(rows.column(c) for c in (*by, "id", "v")), pa.array(cell), pa.array(far)], schema=out)

    placed = T.StructType([*kind(rows, [*by, "id", "v"]), T.StructField("cell", long), T.StructField("far", double)])
    cells = materialize(_with_all(some.drop("n"), pivots, large, by, ["cell", "c"], nearest, placed), "cells")
    counted = cells.groupBy(*by, "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("split"))
    cells = cells.join(counted, [*by, "cell"]).withColumn("own", F.xxhash64("cell", F.pmod(F.xxhash64("id"), F.col("split"))))
    cells = materialize(cells.drop("split"), "cells")
    balls = cells.groupBy(*by, "cell", "own").agg(F.max("far").alias("radius"))
    origin = F.transform(F.col("_v"), lambda x: x * 0)
    shape = cells.groupBy(*by).agg(F.first("v").alias("_v"))
    balls = materialize(balls.join(pivots, [*by, "cell"], "left").join(shape, by).select(*by, "own", "radius", F.coalesce("c", origin).alias("c")), "balls")

    def visits(rows: pa.Table, balls: pa.Table, out: pa.Schema) -> pa.Table:
        """Each row with the list of blocks that it visits: it is copied to them by Spark, one at a time, and not here."""
        x, c = _matrix(rows.column("v")), _matrix(balls.column("c"))
        own, other, radius = rows.column("own").to_numpy(), balls.column("own").to_numpy(), balls.column("radius").to_numpy()
        order = np.argsort(other)
        mine = order[np.searchsorted(other[order], own)]  # the ball of each row
        apart = np.concatenate([_distances(c[some], c) > radius[some, None] + radius[None, :] + reach + SLACK for some in _slices(len(c), len(c))])
        size, found = np.zeros(len(x), np.int64), []
        for some in _slices(len(x), len(c)):
            near = (_distances(x[some], c) <= radius[None, :] + reach + SLACK) & ~apart[mine[some]]
            near[np.arange(len(near)), mine[some]] = True
            size[some] = near.sum(axis=1)
            found.append(other[np.nonzero(near)[1]])
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        visited = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
        return pa.table([*rows.select([*by, "id", "v"]).columns, pa.array(own), visited], schema=out)

    made = T.StructType([*kind(rows, [*by, "id", "v"]), T.StructField("own", long), T.StructField("others", T.ArrayType(long))])
    seen = _with_all(cells.drop("far", "cell"), balls, large, by, ["own", "radius", "c"], visits, made).withColumn("other", F.explode("others"))
    return small.unionByName(seen.select(*by, "id", "v", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")))
