"""Which hashes belong to a set, asked of a broadcast Bloom filter or, for a large set, of a join.

Either way the answer may be too generous, never too strict: it thins out work and decides nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.llm import bloom
from reelgraph.llm.skew import join_counted

Has = Callable[[pa.RecordBatch, np.ndarray], np.ndarray]


def sift(docs: DataFrame, again: DataFrame, rows: Callable[[], DataFrame], max_keys: int | None = None, column: str = "seen") -> tuple[DataFrame, Has]:
    """(docs, has): has(part, hashes) masks the hashes of a part of docs (id, key, text) that again (h, n) may hold.

    rows() gives (h, id, key) of all hashes of docs. It is asked for only if there are more than
    max_keys keys: then those found again are listed beside the document that has them, in a column
    (bounded by the document), and nothing is broadcast.
    """
    shared = bloom.build(again, "h", max_keys=max_keys)
    if shared is not None:
        return docs, lambda part, hashes: shared.value.has(hashes)
    found = join_counted(rows().select("h", F.col("id").alias("i"), F.col("key").alias("k")), again.select("h", "n"), ["h"])
    listed = found.groupBy("i", "k").agg(F.collect_set("h").alias(column))
    out = docs.join(listed, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left").select(*docs.columns, column)

    def has(part, hashes):
        return np.isin(hashes.view(np.int64), part.column(column).flatten().to_numpy(zero_copy_only=False))

    return out, has
