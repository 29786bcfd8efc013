"""A Bloom filter over 64-bit hashes: built in Spark, of bounded size, tested in Arrow batches.

It only ever thins out work: a false positive passes a row on to the exact step behind it. A set of
more than MAX_KEYS keys gets no filter; who asked for one must then have another way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = 256
#: Keys of a filter at most, and so, at 16 bits a key, 32 MB that are broadcast.
MAX_KEYS = 1 << 24


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Anchors are least values, so their high bits say little; these do."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _places(x: np.ndarray, block_bits: int) -> list[np.ndarray]:
    mask, base = np.uint64(block_bits - 1), (x >> np.uint64(56)) * np.uint64(block_bits)
    return [base + ((x >> np.uint64(s)) & mask) for s in (0, 17, 34)]


class Bloom:
    def __init__(self, bits: np.ndarray | None):
        self.bits = bits

    def __contains__(self, hashes):
        raise TypeError("use has()")

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """A mask of the hashes (uint64) that may be in the set."""
        if self.bits is None or not len(hashes):
            return np.zeros(len(hashes), bool)
        out = np.ones(len(hashes), bool)
        for at in _places(_spread(hashes), len(self.bits) * 8 // BLOCKS):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return out


def build(df: DataFrame, column: str, keys: int | None = None, max_keys: int | None = None):
    """A broadcast Bloom of a long column, None beyond max_keys. Each task fills the blocks dealt to it; the driver joins 256 of them."""
    keys = df.count() if keys is None else keys
    if keys > (MAX_KEYS if max_keys is None else max_keys):
        return None
    bits = None
    if keys:
        size = max(1 << 16, 1 << int(8 * keys - 1).bit_length())  # 8 to 16 bits a key
        block = size // BLOCKS

        def deal(batches):
            for batch in batches:
                # a key that many rows share travels once from each batch
                x = np.unique(_spread(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array((x >> np.uint64(56)).astype(np.int32)), pa.array(x.view(np.int64))], names=["block", "x"])

        def fill(batches):
            own: dict[int, np.ndarray] = {}
            for batch in batches:
                block_of = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                for b in np.unique(block_of).tolist():
                    to = own.setdefault(b, np.zeros(block // 8, np.uint8))
                    for at in _places(x[block_of == b], block):
                        at = at - np.uint64(b * block)
                        np.bitwise_or.at(to, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
            for b, x in own.items():
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "bits": pa.array([x.tobytes()], pa.binary())})

        dealt = df.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("h")).mapInArrow(deal, "block int, x long").repartition("block")
        bits = np.zeros(size // 8, np.uint8)
        for row in dealt.mapInArrow(fill, "block int, bits binary").collect():
            bits[row["block"] * block // 8 : (row["block"] + 1) * block // 8] = np.frombuffer(row["bits"], np.uint8)
    return df.sparkSession.sparkContext.broadcast(Bloom(bits))
