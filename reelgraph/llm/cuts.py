"""Taking spans out of texts: which documents have any is asked of a Bloom filter first.

Documents without spans are finished where they are read; only those that may have some meet their
spans in a shuffle. A span list belongs to one document, so it is bounded by that document's length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgraph.llm import bloom
from reelgraph.llm.common import field, map_texts, materialize, text_key


def keyed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, key, text): id and key name a document's text; rows that share both are copies of one row."""
    return df.select(F.col(id_col).alias("id"), text_key(text).alias("key"), F.col(text).alias("text"))


def merge_spans(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by spans (n x 2)."""
    if not len(spans):
        return []
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return list(zip(spans[at, 0].tolist(), reach[np.concatenate([at[1:] - 1, [len(spans) - 1]])].tolist(), strict=True))


def cut(df: DataFrame, spans: DataFrame, id_col: str, text: str, apply: Callable, kept: T.StructField, sizes: list[str], max_keys: int | None = None) -> DataFrame:
    """(id_col, sizes.., kept) for each row of df. spans has (id, key, spans array<struct<start,end>>), one row per document.

    apply(text, runs) gives ([numbers..], kept). If more than max_keys documents have spans, all meet theirs in the shuffle.
    """
    docs, spans = keyed(df, id_col, text), materialize(spans, "spans")
    has = bloom.build(spans, "key", max_keys=max_keys)
    schema = T.StructType([field(df, id_col), *(T.StructField(n, T.LongType(), False) for n in sizes), kept])

    def maybe(part):
        return has.value.has(part.column("key").to_numpy(zero_copy_only=False).view(np.uint64))

    def clean(part):
        part = part.filter(pa.array(~maybe(part)))
        out = [apply(x or "", []) for x in part.column("text").to_pylist()]
        return [part.column("id"), *([x[0][i] for x in out] for i in range(len(sizes))), [x[1] for x in out]]

    def rest(part):
        part = part.filter(pa.array(maybe(part)))
        return [part.column("id"), part.column("key"), part.column("text")]

    def finish(part):
        out = []
        for x, found in zip(part.column("text").to_pylist(), part.column("spans"), strict=True):
            found = found.values
            found = np.zeros((0, 2), np.int64) if found is None else np.stack([found.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)], axis=1)
            out.append(apply(x or "", merge_spans(found)))
        return [part.column("id"), *([x[0][i] for x in out] for i in range(len(sizes))), [x[1] for x in out]]

    some = docs if has is None else map_texts(docs, rest, docs.schema)
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))
    some = some.join(spans.select(F.col("id").alias("i"), F.col("key").alias("k"), "spans"), same, "left").select("id", "text", "spans")
    found = map_texts(some, finish, schema)
    return found if has is None else map_texts(docs, clean, schema).unionByName(found)
