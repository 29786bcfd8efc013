"""SimHash near-duplicates: fingerprints, and exact links within a Hamming radius.

A text is lower-cased (A-Z) and cut into words; each shingle of consecutive words is hashed with
XXH64 (seed 42), and a fingerprint bit is set if it is set in over half of the hashes. Distinct
fingerprints are compared exactly, tile against tile, with numpy's exclusive or and bit counts; in a
tile they stand in order of their population count, and tile pairs whose counts differ by more than
the radius are skipped. The tiles are cut within buckets of an exact split: radius + 1 bit blocks, of
which two fingerprints within the radius share one at least. A bucket of over TILE fingerprints is
dealt as pairs of tiles, so no task holds more than two. Its tiles are ranges of the population count,
and pairs of tiles whose ranges lie further apart than the radius are never made. Copies collapse
before the comparison, and a tile pair reports a spanning forest of its links, so a group of n near
copies gives at most n - 1 rows. Rows are joined back to their fingerprint's component with frequent
fingerprints split (see skew.py).

Cases: a null, empty or wordless text has fingerprint zero and links like any other; fewer words than
a shingle make one shingle; a bit set in exactly half of the hashes is 0; equal fingerprints are one
component; rows that repeat, or whose id does, are kept each; a null id never names a component unless
no other id is in it; very long texts are hashed by blocks; other columns are left out, whatever their
names. No rows in, no rows out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgraph.llm.common import SLICE_BYTES, field, map_texts, materialize, text_key, word_blocks
from reelgraph.llm.skew import join_counted
from reelgraph.operators.graph import connected_components, forest

SEED = 42
#: Fingerprints in a tile.
TILE = 4096
_ROWS, _COLUMNS = 256, 4096
_CHUNK = 1 << 16


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each k neighbouring words, joined by spaces."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], "<u8")


def fingerprint(text: str | None, words_in_shingle: int = 4, limit: int = SLICE_BYTES) -> int:
    """The 64-bit fingerprint of one text; a long one is hashed by blocks, of which each begins with the last words of the one before."""
    counts, n, k, words = np.zeros(64, np.int64), 0, words_in_shingle, []
    for block in word_blocks((text or "").encode().lower(), limit):
        words += block.split()
        if len(words) < k:
            continue
        hashes = shingle_hashes(words, k)
        for at in range(0, len(hashes), _CHUNK):
            counts += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n, words = n + len(hashes), words[len(words) - k + 1 :]
    if not n:
        return int(shingle_hashes(words, len(words))[0]) if words else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", words_in_shingle: int = 4) -> DataFrame:
    """(id, fp long) of each row."""
    schema = T.StructType([field(df, id_col, "id"), T.StructField("fp", T.LongType(), False)])

    def run(part):
        fp = np.array([fingerprint(x, words_in_shingle) for x in part.column(1).to_pylist()], np.uint64)
        return [part.column(0), pa.array(fp.view(np.int64))]

    return map_texts(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), run, schema)


def close_pairs(fps: np.ndarray, counts: np.ndarray, radius: int):
    """Index pairs within the radius; fps stand in order of their population counts."""
    for at in range(0, len(fps), _ROWS):
        end = min(at + _ROWS, len(fps))
        last = int(np.searchsorted(counts, counts[end - 1] + radius, "right"))  # beyond it each tile is skipped
        for to in range(at, last, _COLUMNS):
            near = np.bitwise_count(fps[at:end, None] ^ fps[None, to : min(to + _COLUMNS, last)]) <= radius
            a, b = np.nonzero(near)
            a, b = a + at, b + to
            keep = a < b
            if keep.any():
                yield a[keep], b[keep]


def links(nodes: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(src, dst) fingerprints that hang together, of the distinct longs in nodes.fp: a spanning forest per bucket."""
    if not 0 <= radius < 32:
        raise ValueError("radius must be 0 to 31")
    blocks = radius + 1
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    keys = F.array(*(
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)).alias("value"))
        for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))
    ))
    rows = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.block", "k.value")
    bits = F.bit_count("fp").cast("int")
    each = materialize(rows.groupBy("block", "value", bits.alias("bits")).count(), "tiles")
    large = each.groupBy("block", "value").agg(F.sum("count").alias("n")).where(F.col("n") > tile).drop("n")
    # tiles follow the population count, so those within reach of a fingerprint are neighbours; a bucket has 65 counts at most
    by = Window.partitionBy("block", "value").orderBy("bits")
    before = F.coalesce(F.sum("count").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = each.join(large, ["block", "value"], "left_semi").withColumns({"first": F.floor(before / tile).cast("int"), "parts": F.ceil(F.col("count") / tile).cast("int")})
    reach = by.rangeBetween(-radius, radius)
    cut = cut.withColumns({"from": F.min("first").over(reach), "to": F.max(F.col("first") + F.col("parts") - 1).over(reach)}).drop("count")
    own = F.when(F.col("first").isNull(), 0).otherwise(F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = (
        rows.withColumn("bits", bits).join(cut, ["block", "value", "bits"], "left").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.coalesce("from", F.lit(0)), F.coalesce("to", F.lit(0)))))
        .select("fp", "block", "value", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    group = ["block", "value", "lo", "hi"]

    def compare(batches):
        held, key = [], None

        def done():
            fps = np.concatenate(held)
            if len(fps) < 2:
                return None
            parent = forest(len(fps), close_pairs(fps, np.bitwise_count(fps), radius))
            moved = np.nonzero(parent != np.arange(len(fps)))[0]
            if not len(moved):
                return None
            return pa.RecordBatch.from_arrays([pa.array(fps[moved].view(np.int64)), pa.array(fps[parent[moved]].view(np.int64))], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in group], axis=1)
            cuts = [0, *(np.nonzero((ids[1:] != ids[:-1]).any(axis=1))[0] + 1).tolist(), len(fps)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if (this := tuple(ids[a])) != key:
                    if held and (out := done()):
                        yield out
                    held, key = [], this
                held.append(fps[a:b])
        if held and (out := done()):
            yield out

    dealt = rows.repartition(*group).sortWithinPartitions(*group, F.bit_count("fp"), "fp")
    return dealt.mapInArrow(compare, "src long, dst long")


def representatives(df: DataFrame, id_col: str = "doc_id", text: str = "text", words_in_shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id, key, n): of each component the row that is least by id (null last), then text key, and how many rows of df share both."""
    schema = T.StructType([field(df, id_col, "id"), T.StructField("key", T.LongType(), False), T.StructField("fp", T.LongType(), False)])

    def run(part):
        fp = np.array([fingerprint(x, words_in_shingle) for x in part.column("text").to_pylist()], np.uint64)
        return [part.column("id"), part.column("key"), pa.array(fp.view(np.int64))]

    rows = map_texts(df.select(F.col(id_col).alias("id"), text_key(text).alias("key"), F.col(text).alias("text")), run, schema)
    fps = materialize(rows.groupBy("id", "key", "fp").agg(F.count(F.lit(1)).alias("n")), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "n")).alias("least")), "simhash")
    reached = connected_components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = nodes.join(reached, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return named.groupBy("component").agg(F.min("least").alias("least")).select("least.id", "least.key", "least.n")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", words_in_shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id_col, fp long, component): component is the smallest id that links reach."""
    fps = materialize(fingerprints(df, id_col, text, words_in_shingle), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash")
    reached = connected_components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = nodes.join(reached, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("name"))
    named = materialize(named.select("fp", "n", "component").join(least, "component").select("fp", "n", "name"), "simhash")
    return join_counted(fps, named, ["fp"]).select(F.col("id").alias(id_col), "fp", F.col("name").alias("component"))
