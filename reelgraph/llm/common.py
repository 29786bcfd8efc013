"""Helpers for operators that work on whole texts in Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reelgraph.runtime import discard, materialize, scratch, shared_dir  # noqa: F401

#: Bytes of text that one step of a vectorised pass holds at a time.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch of whole texts, where the session has not set another number.
BATCH_ROWS = 1000
_ROWS_KEY, _ROWS_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `limit` bytes in a string or binary column (one row at least)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def segments(part: pa.RecordBatch, column: str, limit: int, cut: Callable) -> Iterator[pa.RecordBatch]:
    """The part with a column `base` of zeros; but a single long text as several rows, one at a time: cut(bytes, limit) gives (base, bytes)."""
    text = part.column(column)
    if part.num_rows == 1 and text[0].is_valid and pc.binary_length(text)[0].as_py() > 4 * limit:
        at = part.schema.get_field_index(column)
        for base, piece in cut(memoryview(text[0].as_buffer()).cast("B"), limit):
            columns = [pa.array([bytes(piece)], pa.binary()) if i == at else c for i, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([base], pa.int64())], names=[*part.schema.names, "base"])
    else:
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.zeros(part.num_rows, np.int64))], names=[*part.schema.names, "base"])


def give_back() -> None:
    """Return the memory that a finished task no longer needs; its Python worker lives on for the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(df: DataFrame) -> None:
    """Let the session's Arrow batches hold BATCH_ROWS rows, unless its number of rows is not the default."""
    conf = df.sparkSession.conf
    if conf.get(_ROWS_KEY) == _ROWS_DEFAULT:
        conf.set(_ROWS_KEY, str(BATCH_ROWS))


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], list], schema: T.StructType, column: str = "text", limit: int | None = None, cut: Callable | None = None) -> DataFrame:
    """mapInArrow of fn over slices of the batches; fn returns the output columns as Arrow arrays or lists.

    With `cut`, a long text comes in segments of about `limit` bytes, so what fn makes of it is bounded;
    the part's column `base` says where a segment begins (0: a whole text), and its text is binary.
    """
    limit = limit or SLICE_BYTES
    small_batches(df)

    def run(batches):
        out = to_arrow_schema(schema)
        try:
            for batch in batches:
                for whole in slices(batch, column, limit):
                    for part in segments(whole, column, limit, cut) if cut else (whole,):
                        cols = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(fn(part), out, strict=True)]
                        cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
                        yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(cols, out, strict=True)], schema=out)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string or binary column, without copying; a null is an empty run."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def field(df: DataFrame, name: str, to: str | None = None) -> T.StructField:
    return T.StructField(to or name, df.schema[name].dataType, True)


def text_key(text: str) -> F.Column:
    """A 64-bit key of a text; with the row's id it names a document even where ids repeat."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.length(F.coalesce(F.col(text), F.lit(""))))


def byte_cuts(width: int) -> Callable:
    """For segments: every window of `width` bytes lies in one segment, and begins in one only."""

    def cut(data, limit):
        for at in range(0, max(1, len(data) - width + 1), limit):
            yield at, data[at : min(len(data), at + limit + width - 1)]

    return cut


def word_blocks(data: bytes, limit: int) -> Iterator[bytes]:
    """Parts of about `limit` bytes that end where a word does (words are runs between ASCII white space)."""
    at = 0
    while at < len(data):
        end = at + limit
        while end < len(data) and data[end] not in b"\x20\x09\x0a\x0b\x0c\x0d":
            found = _gap(data[end : end + limit])
            end = end + (limit if found is None else found)
        yield bytes(data[at : min(end, len(data))])
        at = min(end, len(data))


def _gap(part) -> int | None:
    """Place of the first white space."""
    part = np.frombuffer(part, np.uint8)
    hit = (part == 0x20) | ((part >= 0x09) & (part <= 0x0D))
    at = int(hit.argmax()) if len(hit) else 0
    return at if len(hit) and hit[at] else None


def word_cuts(width: int, count: Callable = lambda block: len(block.split())) -> Callable:
    """For segments: every window of `width` words lies in one segment, and begins in one only; base counts words.

    White space parts words; where other bytes do too, count tells how many words a block has, and width is 1.
    """

    def cut(data, limit):
        blocks, base = list(_block_ends(data, limit)), 0
        for i, (start, end) in enumerate(blocks):
            block = bytes(data[start:end])
            more, need, j = [], width - 1, i + 1
            while need > 0 and j < len(blocks):  # the words that the last windows reach
                words = bytes(data[blocks[j][0] : blocks[j][1]]).split(None, need)[:need]
                more += words
                need, j = need - len(words), j + 1
            yield base, b" ".join([block, *more])
            base += count(block)

    return cut


def _block_ends(data, limit: int) -> Iterator[tuple[int, int]]:
    at = 0
    for block in word_blocks(data, limit):
        yield at, at + len(block)
        at += len(block)
