"""Byte-level BPE: encoding with a segment tree of pair ranks, and decoding.

Within a piece (one match of the splitting pattern) the tree stands over byte positions; a leaf
holds rank and position of the pair that begins there, an inner node the smaller of its children,
so the root is the leftmost pair of least rank. A merge changes the leaves of the merged pair, of
its dead right half and of the live left neighbour: three logarithmic point updates. A piece of n
bytes takes O(n log n), also where a text is one endless piece. Most pieces are short and many are
equal: the distinct short ones of a slice of texts stand in a matrix, one tree a row, and numpy takes
one merge of all of them at a time. Long pieces go through one tree each.

Cases: a null or empty text has no ids; null ids decode to no bytes; of pairs of equal rank the
leftmost is merged; repeated rows are encoded each; very long texts are split and encoded some pieces
at a time; an empty table gives an empty result; other columns are kept, whatever their names, and
one that is named like the output is replaced.
"""

from __future__ import annotations

import base64
from array import array
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reelgraph.llm.common import field, give_back, map_texts, small_batches
from reelgraph.llm.lookup import Lookup

_END = 1 << 62
#: Pieces that are looked up at a time, characters that make a text long, and bytes from which a tree is kept in plain words.
_PIECES, _LONG, _LARGE = 1 << 17, 1 << 20, 1 << 14
#: Sizes of trees that stand in a matrix, and its rows.
_SIZES, _ROWS = (4, 8, 16, 32, 64), 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file (base64 token and rank per line). Read on the driver: a vocabulary is of fixed size."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder for one vocabulary; each worker makes its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        self.single: dict[str, int] = {}  # pieces that are one token
        pairs, made = [], []
        for token, rank in ranks.items():
            self.tokens[rank] = token
            try:
                self.single[token.decode()] = rank
            except UnicodeDecodeError:  # a part of a character
                pass
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    made.append(rank)
        #: The token that two neighbours make, by both.
        self.pairs = Lookup(np.array(pairs, np.uint64), np.array(made, np.int64))
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)])

    def merge(self, piece: bytes) -> np.ndarray:
        """Ids of one piece."""
        rank = self.ranks.get
        if (whole := rank(piece)) is not None:
            return np.array([whole], np.int32)
        n = len(piece)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        size = 1 << (n - 1).bit_length()
        tree = [_END] * (2 * size) if n < _LARGE else array("q", (_END,)) * (2 * size)
        for i in range(n - 1):
            if (r := rank(piece[i : i + 2])) is not None:
                tree[size + i] = r << shift | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        row = list if n < _LARGE else lambda x: array("q", x)
        after, before = row(range(1, n + 1)), row(range(-1, n - 1))

        def put(i, value):
            i += size
            tree[i] = value
            while i > 1:
                other = tree[i ^ 1]
                i >>= 1
                if other < value:
                    value = other
                if tree[i] == value:
                    return
                tree[i] = value

        while (top := tree[1]) != _END:
            i = top & mask
            j = after[i]
            k = after[j]
            after[i] = k
            put(j, _END)
            r = None
            if k < n:
                before[k] = i
                r = rank(piece[i : after[k]])
            put(i, _END if r is None else r << shift | i)
            if i:
                h = before[i]
                r = rank(piece[h:k])
                put(h, _END if r is None else r << shift | h)
        out, i = array("i"), 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return np.array(out, np.int32)

    def _made(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
        """Leaves of pairs of tokens that begin at places."""
        rank, hit = self.pairs.get(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
        return np.where(hit, rank << shift | at, _END)

    def merge_many(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has) of pieces of at most `size` bytes, a power of two."""
        rows, shift = len(pieces), size.bit_length()
        length = np.fromiter(map(len, pieces), np.int64, rows)
        place = np.arange(size)
        live = place < length[:, None]
        token = np.zeros((rows, size), np.int64)
        token[live] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        tree = np.full((rows, 2 * size), _END)
        leaves = self._made(token[:, :-1].ravel(), token[:, 1:].ravel(), np.tile(place[:-1], rows), shift).reshape(rows, size - 1)
        tree[:, size:-1] = np.where(live[:, 1:], leaves, _END)
        for i in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        after, before = np.tile(place + 1, (rows, 1)), np.tile(place - 1, (rows, 1))
        tree, token, after, before, alive = tree.ravel(), token.ravel(), after.ravel(), before.ravel(), live.ravel()

        def put(row, at, value):
            base, node = row * (2 * size), at + size
            tree[base + node] = value
            for _ in range(shift - 1):
                value = np.minimum(value, tree[base + (node ^ 1)])
                node = node >> 1
                tree[base + node] = value

        row = np.arange(rows)
        while True:
            top = tree[row * (2 * size) + 1]
            row, top = row[top != _END], top[top != _END]
            if not len(row):
                return token[alive].astype(np.int32), live.sum(axis=1)
            i, new, base, end = top & ((1 << shift) - 1), top >> shift, row * size, length[row]
            j = after[base + i]
            k = after[base + j]
            token[base + i], after[base + i], alive[base + j] = new, k, False
            put(row, j, _END)
            more = k < end
            before[(base + k)[more]] = i[more]
            leaf = np.full(len(row), _END)
            leaf[more] = self._made(new[more], token[(base + k)[more]], i[more], shift)
            put(row, i, leaf)
            h = before[base + i]
            left = h >= 0
            put(row[left], h[left], self._made(token[(base + h)[left]], new[left], h[left], shift))

    def _distinct(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has)."""
        ids = np.fromiter((self.single.get(p, -1) for p in pieces), np.int64, len(pieces))
        count = np.ones(len(pieces), np.int64)
        rest = np.flatnonzero(ids < 0)
        coded = [pieces[i].encode() for i in rest]
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        done = [(np.flatnonzero(ids >= 0), ids[ids >= 0])]
        for low, size in zip((0, *_SIZES), _SIZES, strict=False):
            these = np.flatnonzero((length > low) & (length <= size))
            for at in range(0, len(these), _ROWS):
                some = these[at : at + _ROWS]
                got, n = self.merge_many([coded[i] for i in some], size)
                count[rest[some]] = n
                done.append((rest[some], got))
        for i in np.flatnonzero(length > _SIZES[-1]):
            got = self.merge(coded[i])
            count[rest[i]] = len(got)
            done.append((rest[i : i + 1], got))
        start = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for of, got in done:
            n = count[of]
            out[np.repeat(start[of] - (np.cumsum(n) - n), n) + np.arange(len(got))] = got
        return out, count

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has); equal pieces are merged once."""
        index: dict[str, int] = {}
        of = np.array([index.setdefault(p, len(index)) for p in pieces], np.int64)
        ids, count = self._distinct(list(index))
        n = count[of]
        return ids[np.repeat((np.cumsum(count) - count)[of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's); pieces are split and merged _PIECES at a time."""
        total, ids, held, owner = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)], [], []

        def done():
            got, n = self._pieces(held)
            ids.append(got)
            np.add.at(total, np.repeat([t for t, _ in owner], [k for _, k in owner]), n)
            held.clear()
            owner.clear()

        for t, text in enumerate(texts):
            for some in [self.pattern.findall(text)] if len(text) < _LONG else batched((m.group() for m in self.pattern.finditer(text)), _PIECES):
                held.extend(some)
                owner.append((t, len(some)))
                if len(held) >= _PIECES:
                    done()
        if held:
            done()
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(total)])

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return self.encode_many([text])[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple, Codec] = {}


class Vocabulary:
    """What tasks need to build a Codec; broadcast once, as its size is the vocabulary's."""

    def __init__(self, spark, path: str, pattern: str):
        self.key = (path, pattern)
        self.pattern = pattern
        self.shared = spark.sparkContext.broadcast(read_ranks(path))

    def codec(self) -> Codec:
        if self.key not in _CODECS:
            _CODECS[self.key] = Codec(self.shared.value, self.pattern)
        return _CODECS[self.key]


_IDS = T.ArrayType(T.IntegerType(), False)


def _fields(df: DataFrame, keep: list[str] | None, *out: T.StructField) -> tuple[list[str], T.StructType]:
    keep = [c for c in (df.columns if keep is None else keep) if c not in {x.name for x in out}]
    return keep, T.StructType([*(field(df, c) for c in keep), *out])


def _encoded(codec: Codec, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    ids, offsets = codec.encode_many([x or "" for x in column.to_pylist()])
    return ids, offsets, pa.ListArray.from_arrays(offsets.astype(np.int32), ids, type=pa.list_(pa.field("element", pa.int32(), False)))


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """df with the ids of each whole text; keep names the columns to return beside them (None: all)."""
    keep, schema = _fields(df, keep, T.StructField(ids, _IDS, False))

    def run(part):
        return [*(part.column(c) for c in keep), _encoded(vocabulary.codec(), part.column(text))[2]]

    return map_texts(df, run, schema, text)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """df with the bytes that the ids stand for."""
    keep, schema = _fields(df, keep, T.StructField(decoded, T.BinaryType(), False))
    small_batches(df)

    def run(batches):
        codec = vocabulary.codec()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [codec.decode(x.values.to_pylist()) if x.is_valid else b"" for x in part.column(ids)]
                cols = [*(part.column(c) for c in keep), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, decoded])
        give_back()

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """df with the ids of each whole text and the bytes that these decode to: encode(), then decode() of its ids, in one task and worker."""
    keep, schema = _fields(df, keep, T.StructField(ids, _IDS, False), T.StructField(decoded, T.BinaryType(), False))

    def run(part):
        codec = vocabulary.codec()
        ids, offsets, listed = _encoded(codec, part.column(text))
        return [*(part.column(c) for c in keep), listed, pa.array([codec.decode(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:])], pa.binary())]

    return map_texts(df, run, schema, text)
