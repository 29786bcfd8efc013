"""Token counts of documents without their token ids.

A tokenizer splits a text into pre-tokens and each pre-token into pieces. The pieces of a pre-token do
not depend on where it stands, so they are counted once per distinct pre-token. One pass over the texts
makes, for each slice of documents, the frequencies of pre-tokens of each document, as numbers in a
list of the slice's distinct pre-tokens, and that list, dealt over buckets by hash. All lists of a bucket
meet in a task, which counts the pieces of each of its distinct pre-tokens; the counts go back to their
slices, where they are joined to the frequencies and summed. A pre-token that every text has comes
once from each slice, so no key is hot.

The tokenizer is a file of the tokenizers library. Counts are those of its encode() without begin and
end tokens; added tokens found in a text are one token each, as is its default.

Cases: a null text counts as empty, which has no tokens; repeated rows are counted each, whatever their
ids; a very long text is split at white space some MB at a time, which no pre-token crosses; an empty
table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgraph.llm.common import give_back, materialize, slices, small_batches, word_blocks

#: Bytes of text, rows and distinct pre-tokens from which a slice is ended.
SLICE_BYTES, SLICE_ROWS, SLICE_TOKENS = 32 << 20, 100_000, 1 << 20
#: Bytes of a long text that are split at a time.
_BLOCK = 1 << 22
#: Below this code point nothing is changed by NFC, and lower case is one code point each but for U+0130.
_PLAIN = regex.compile("[^\\x00-\\u012F\\u0131-\\u024F]")
_SPACE = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}


class Splitter:
    """Pre-tokens of texts, and the number of pieces of pre-tokens, by a file of the tokenizers library; each worker makes its own.

    The file must split by one pattern whose matches hold no white space, map bytes to characters, and
    have a model without state; its added tokens must be found as they stand.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        split, mapped = spec["pre_tokenizer"]["pretokenizers"]
        if (split["type"], split["behavior"], split["invert"], mapped["type"], mapped["use_regex"], mapped["add_prefix_space"]) != ("Split", "Removed", True, "ByteLevel", False, False):
            raise ValueError("not a tokenizer that keeps the matches of one pattern, as bytes")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that depend on what stands beside them")
        self.tokenizer = Tokenizer.from_str(definition)
        bare = spec | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(bare))
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.plain = [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and spec["normalizer"]["normalizers"][1] == _SPACE
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in shown]
        self.letters = {b: 0x100 + i for i, b in enumerate(rest)}

    def _split(self, text: str) -> list[str]:
        if self.plain and not _PLAIN.search(text):
            return self.pattern.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """(how often each pre-token stands in the text, number of added tokens in it)."""
        found, special = Counter(), 0
        long = len(text) > _BLOCK
        for block in (b.decode() for b in word_blocks(text.encode(), _BLOCK)) if long else (text,):
            parts = self.added.split(block) if self.added else [block]
            special += len(parts) - 1
            for part in parts:
                if part:
                    found.update(self._split(part))
        return found, special

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        """The number of pieces of each."""
        shown = [t.encode().decode("latin-1").translate(self.letters) for t in pre_tokens]
        return [len(e.ids) for e in self.model.encode_batch(shown, add_special_tokens=False)]


_SPLITTERS: dict[str, Splitter] = {}


class Definition:
    """A tokenizer file, broadcast once; its size is the vocabulary's."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            self.shared = spark.sparkContext.broadcast(f.read())
        self.path = path

    def splitter(self) -> Splitter:
        if self.path not in _SPLITTERS:
            _SPLITTERS.clear()
            _SPLITTERS[self.path] = Splitter(self.shared.value)
        return _SPLITTERS[self.path]


class _Slice:
    """Documents with the numbers of their pre-tokens in the slice's list."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.bytes, self.special, self.sizes, self.at, self.times = [], [], [], [], [], []
        self.held = 0

    def add(self, splitter: Splitter, text: str) -> None:
        found, special = splitter.frequencies(text)
        number = self.number
        self.at.append(np.fromiter((number.setdefault(t, len(number)) for t in found), np.int64, len(found)))
        self.times.append(np.fromiter(found.values(), np.int64, len(found)))
        self.sizes.append(len(found))
        self.special.append(special)

    def full(self, rows: int) -> bool:
        return self.held >= SLICE_BYTES or len(self.sizes) >= rows or len(self.number) >= SLICE_TOKENS

    def rows(self, buckets: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The row of the documents, then a row for each bucket. Pre-tokens are numbered anew, by bucket."""
        name, tokens = uuid.uuid4().hex, list(self.number)
        bucket = np.fromiter((zlib.crc32(t.encode()) % buckets for t in tokens), np.int64, len(tokens))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(tokens), np.int64)
        place[order] = np.arange(len(tokens))
        sizes = np.array(self.sizes, np.int64)
        at, times = place[np.concatenate([*self.at, np.zeros(0, np.int64)])], np.concatenate([*self.times, np.zeros(0, np.int64)])
        by = np.lexsort((at, np.repeat(np.arange(len(sizes)), sizes)))
        packed = pack(at[by], sizes), _squeeze(times[by])
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
        docs = [pa.array([name]), pa.array([None], pa.int32()), one(pa.concat_arrays(self.ids), None), one(self.bytes, pa.int64()), one(self.special, pa.int64()), one(self.sizes, pa.int32()), *(pa.array([x], pa.binary()) for x in packed), pa.array([None], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(docs, schema, strict=True)], schema=schema)
        starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for some in range(0, len(starts), 256):
            first = starts[some : some + 256]
            ends = [*starts[some + 1 : some + 257].tolist(), *([len(tokens)] if some + 256 >= len(starts) else [])]
            held = pa.array([tokens[i] for i in order[first[0] : ends[-1]]], pa.string())
            lists = pa.ListArray.from_arrays(pa.array([*(first - first[0]).tolist(), ends[-1] - int(first[0])], pa.int32()), held)
            cols = [pa.array([name] * len(first)), pa.array(bucket[order[first]], pa.int32()), *(pa.nulls(len(first), f.type) for f in list(schema)[2:8]), lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers of up to 32 bits, byte by byte of each, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unsqueeze(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def pack(at: np.ndarray, sizes: np.ndarray) -> bytes:
    """Numbers that ascend within each of the runs that sizes tells, as gaps."""
    gaps = np.diff(at, prepend=0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    gaps[first] = at[first]
    return _squeeze(gaps)


def unpack(data: bytes, sizes: np.ndarray) -> np.ndarray:
    gaps = _unsqueeze(data)
    total = np.cumsum(gaps)
    first = np.cumsum(sizes) - sizes
    base = np.where(sizes > 0, np.append(total, 0)[first] - np.append(gaps, 0)[first], 0)
    return total - np.repeat(base, sizes)


def count(df: DataFrame, definition: Definition, id_col: str, text: str, buckets: int | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(id, n_bytes, n_tokens) of each row; buckets (None: as many as shuffle partitions) and slice_rows make no difference to the result."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[id_col].dataType
    many = lambda t: T.ArrayType(t)
    schema = T.StructType([
        T.StructField("slice", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("ids", many(kind)), T.StructField("bytes", many(T.LongType())), T.StructField("special", many(T.LongType())),
        T.StructField("sizes", many(T.IntegerType())), T.StructField("at", T.BinaryType()), T.StructField("times", T.BinaryType()), T.StructField("tokens", many(T.StringType())),
    ])
    small_batches(df)

    def split(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        splitter, now, out = definition.splitter(), _Slice(), to_arrow_schema(schema)
        try:
            for batch in batches:
                for part in slices(batch, "text"):
                    texts = part.column("text")
                    size = pc.fill_null(pc.binary_length(texts), 0)
                    for x in texts.to_pylist():
                        now.add(splitter, x or "")
                    now.ids.append(part.column("id"))
                    now.bytes += size.to_pylist()
                    now.held += pc.sum(size).as_py() or 0
                    if now.full(slice_rows):
                        yield from now.rows(buckets, out)
                        now = _Slice()
            if now.sizes:
                yield from now.rows(buckets, out)
        finally:
            give_back()

    found = materialize(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(split, schema), "frequencies")

    def weigh(batches):
        splitter, known = definition.splitter(), {}
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                lists = part.column("tokens")
                flat = lists.flatten().dictionary_encode()
                distinct = flat.dictionary.to_pylist()
                new = [t for t in distinct if t not in known]
                known.update(zip(new, splitter.pieces(new), strict=True))
                n = pa.array([known[t] for t in distinct], pa.int32()).take(flat.indices)
                offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                yield pa.RecordBatch.from_arrays([part.column("slice"), part.column("bucket"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), n)], names=["slice", "bucket", "n"])
        give_back()

    lists = found.where("bucket IS NOT NULL").select("slice", "bucket", "tokens").repartition(buckets, "bucket")
    weights = lists.mapInArrow(weigh, "slice string, bucket int, n array<int>")
    result = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)])

    def total(docs: pa.Table, weights: pa.Table) -> pa.Table:
        docs, weights = docs.combine_chunks(), weights.combine_chunks().sort_by("bucket")
        sizes = docs.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n = weights.column("n").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) if weights.num_rows else np.zeros(0, np.int64)
        at, times = unpack(docs.column("at")[0].as_py(), sizes), _unsqueeze(docs.column("times")[0].as_py())
        sums = np.concatenate([[0], np.cumsum(n[at] * times)])
        ends = np.cumsum(sizes)
        tokens = sums[ends] - sums[ends - sizes] + docs.column("special").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table([docs.column("ids").combine_chunks().flatten(), docs.column("bytes").combine_chunks().flatten(), pa.array(tokens, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    docs = found.where("bucket IS NULL").select("slice", "ids", "bytes", "special", "sizes", "at", "times")
    return docs.groupBy("slice").cogroup(weights.groupBy("slice")).applyInArrow(total, result)
