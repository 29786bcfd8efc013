"""A Merkle manifest of a dataset: one leaf a row, a tree for each group, and a tree over the groups.

A leaf's place in its group is its rank by id. The ids of a group are kept as bitmaps, one for each
range of 65,536 of them: tasks make partial ones, which are merged. A bitmap with few ids is a list,
another has a directory of the bits set before each run of 512, and the bitmaps of a group have one
of the ids before each, in three steps of up to 65,536 entries. So the rank of an id is read off; leaves
are never sorted. What stands at FAN ** DEPTH consecutive places is a block: its digests go to their
slots in one task, which reduces them DEPTH levels at once; the digests of blocks are the leaves of the
next round. Paths from leaves to the root are handed down the same way.

Nodes are lowercase hex SHA-256 digests of their children's, FAN consecutive ones each (the last of a
level: fewer, even one), while a level has more than one node. The roots of the groups, ordered by
group (null first, else by UTF-8 bytes), are the leaves of the upper tree.

Cases: ids are integers; a null id comes before all others; rows of one id are ordered by leaf digest,
and equal rows follow each other, each with its own place and proof; any field may be null, which is
another leaf than an empty one; a group may hold one row, whose leaf is its root; an empty table has no
rows and no root; columns that are not named are not part of a leaf, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.llm.common import materialize
from reelgraph.llm.skew import join_counted
from reelgraph.operators.rank import positions

#: Children of a node, and levels that one task reduces.
FAN, DEPTH = 3, 8
#: Ids of a bitmap from which it is kept as bits, and bits of a run of its directory.
_SPARSE, _RUN = 4096, 512
#: Rows of which a task makes one set of partial bitmaps.
_PARTIAL = 1 << 20


def leaf(fields: list[Column]) -> Column:
    """Digest of fields: each `-` if null, else its number of UTF-8 bytes, a colon and its text."""
    coded = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


def encode_bitmap(low: np.ndarray) -> tuple[bytes, bytes]:
    """(ids 0 to 65535, ascending, as bits or, if few, as a list; the number of bits set before each run of _RUN)."""
    if len(low) <= _SPARSE:
        return low.astype("<u2").tobytes(), b""
    bits = np.zeros(1 << 16, np.uint8)
    bits[low] = 1
    runs = bits.reshape(-1, _RUN).sum(axis=1, dtype=np.int64)
    return np.packbits(bits, bitorder="little").tobytes(), (np.cumsum(runs) - runs).astype("<u4").tobytes()


def rank(bitmap: bytes, directory: bytes, low: np.ndarray) -> np.ndarray:
    """How many ids of the bitmap are less than each of low."""
    if not directory:
        return np.searchsorted(np.frombuffer(bitmap, "<u2"), low.astype(np.uint16))
    words = np.frombuffer(bitmap, "<u8").reshape(-1, _RUN // 64)
    run, word, bit = low // _RUN, low % _RUN // 64, (low % 64).astype(np.uint64)
    here = words[run]
    full = np.where(np.arange(_RUN // 64) < word[:, None], np.bitwise_count(here), 0).sum(axis=1)
    part = np.bitwise_count(here[np.arange(len(low)), word] & ((np.uint64(1) << bit) - np.uint64(1)))
    return np.frombuffer(directory, "<u4")[run].astype(np.int64) + full + part


def _bitmaps(ids: DataFrame) -> DataFrame:
    """(g, high, bits, directory, more, more_n, total) of ids (g, k, n): ids k >> 16 as one bitmap; more are those with n > 1, more_n how many they add, total the sum of n."""

    def partial(batches):
        held, size = [], 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            code = rows.column("g").combine_chunks().dictionary_encode()
            g, k, n = code.indices.to_numpy(), rows.column("k").to_numpy(), rows.column("n").to_numpy()
            order = np.lexsort((k, g))
            g, k, n = g[order], k[order], n[order]
            new = np.flatnonzero((np.diff(g, prepend=-1) != 0) | (np.diff(k >> 16, prepend=0) != 0))
            ends = [*new[1:].tolist(), len(k)]
            low = [(k[a:b] & 0xFFFF).astype("<u2").tobytes() for a, b in zip(new, ends)]
            yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(g[new])), pa.array(k[new] >> 16), pa.array(low, pa.binary()), pa.array([n[a:b].astype("<i8").tobytes() for a, b in zip(new, ends)], pa.binary())], names=["g", "high", "low", "n"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= _PARTIAL:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def merge(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        low = np.concatenate([np.frombuffer(x, "<u2") for x in parts.column("low").to_pylist()]).astype(np.int64)
        n = np.concatenate([np.frombuffer(x, "<i8") for x in parts.column("n").to_pylist()])
        counts = np.zeros(1 << 16, np.int64)
        np.add.at(counts, low, n)
        low = np.flatnonzero(counts)
        more = low[counts[low] > 1]
        bits, directory = encode_bitmap(low)
        binary = [pa.array([x], pa.binary()) for x in (bits, directory, more.astype("<u2").tobytes(), (counts[more] - 1).astype("<i8").tobytes())]
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), *binary, pa.array([int(n.sum())], pa.int64())], names=["g", "high", "bits", "directory", "more", "more_n", "total"])

    made = ids.select("g", "k", "n").mapInArrow(partial, "g string, high long, low binary, n binary")
    return made.groupBy("g", "high").applyInArrow(merge, "g string, high long, bits binary, directory binary, more binary, more_n binary, total long")


def _before(bitmaps: DataFrame) -> DataFrame:
    """(g, high, before): how many ids of the group's other bitmaps come first, added up over ranges of 2 ** 32, 2 ** 48 and all ids."""
    levels = [bitmaps.select("g", "high", "total")]
    for _ in range(2):
        levels.append(levels[-1].groupBy("g", F.shiftright("high", 16).alias("high")).agg(F.sum("total").alias("total")))
    above = None
    for level in reversed(levels):
        up = F.shiftright("high", 16) if level is not levels[-1] else F.lit(0).cast("long")
        ahead = Window.partitionBy("g", "up").orderBy("high").rowsBetween(Window.unboundedPreceding, -1)
        now = level.withColumn("up", up).withColumn("before", F.coalesce(F.sum("total").over(ahead), F.lit(0)))
        if above is not None:
            now = now.join(above.select("g", F.col("high").alias("up"), F.col("before").alias("_b")), ["g", "up"]).withColumn("before", F.col("before") + F.col("_b"))
        above = now.select("g", "high", "before")
    return above


def ranks(ids: DataFrame) -> DataFrame:
    """(g, k, place) of ids (g, k, n), distinct: the sum of n over the smaller ids of the group."""
    bitmaps = materialize(_bitmaps(ids), "bitmaps")
    placed = bitmaps.drop("total").join(_before(bitmaps), ["g", "high"])

    def ask(rows: pa.Table, bitmap: pa.Table) -> pa.Table:
        k = rows.column("k").to_numpy()
        low = k & 0xFFFF
        bits, directory, more, more_n, before = (bitmap.column(c)[0].as_py() for c in ("bits", "directory", "more", "more_n", "before"))
        extra = np.concatenate([[0], np.cumsum(np.frombuffer(more_n, "<i8"))])[np.searchsorted(np.frombuffer(more, "<u2"), low.astype(np.uint16))]
        return pa.table([rows.column("g"), rows.column("k"), pa.array(before + rank(bits, directory, low) + extra, pa.int64())], names=["g", "k", "place"])

    asked = ids.select("g", F.shiftright("k", 16).alias("high"), "k").groupBy("g", "high")
    return asked.cogroup(placed.groupBy("g", "high")).applyInArrow(ask, "g string, k long, place long")


def _places(leaves: DataFrame) -> DataFrame:
    """leaves (g, k, leaf, now, n), distinct, with place: of n consecutive places in the group the first."""
    ids = materialize(leaves.groupBy("g", "k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("_d")), "ids")
    known = ids.where("k IS NOT NULL")
    absent = ids.where("k IS NULL").select("g", F.col("n").alias("_none"))
    start = materialize(ranks(known).join(known.select("g", "k", F.col("_d").alias("d")), ["g", "k"]), "ranks")
    out = join_counted(leaves.where("k IS NOT NULL"), start.withColumn("c", F.col("d")), ["g", "k"], "c")
    none = leaves.where("k IS NULL").withColumn("place", F.lit(0).cast("long")).withColumn("d", F.lit(2).cast("long"))
    out = out.select(*leaves.columns, "place", "d").unionByName(none.select(*leaves.columns, "place", "d"))
    # rows of one id: by digest, the first 16 bits of which part them into ranges
    shared = out.where("d > 1").withColumn("b", F.conv(F.substring("leaf", 1, 4), 16, 10).cast("int"))
    ranges = shared.groupBy("g", "k", "b").agg(F.sum("n").alias("n"))
    ahead = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("g", "k", "b", F.coalesce(F.sum("n").over(ahead(["g", "k"], "b")), F.lit(0)).alias("_r"))
    own = shared.withColumn("_o", F.coalesce(F.sum("n").over(ahead(["g", "k", "b"], "leaf")), F.lit(0)))
    renamed = ranges.select(F.col("g").alias("_g"), F.col("k").alias("_k"), F.col("b").alias("_b"), "_r")
    own = own.join(renamed, (F.col("g") == F.col("_g")) & F.col("k").eqNullSafe(F.col("_k")) & (F.col("b") == F.col("_b")))
    own = own.select(*leaves.columns, (F.col("place") + F.col("_o") + F.col("_r")).alias("place"))
    out = materialize(out.where("d = 1").select(*leaves.columns, "place").unionByName(own), "places")
    if absent.isEmpty():
        return out
    # groups with null ids: all others come after those
    counted = materialize(out.where("k IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("c")).join(absent, "g"), "absent")
    moved = join_counted(out.where("k IS NOT NULL"), counted, ["g"], "c", how="left")
    moved = moved.withColumn("place", F.col("place") + F.coalesce("_none", F.lit(0))).select(*out.columns)
    return moved.unionByName(out.where("k IS NULL"))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(digests: list[str], lone: bool, depth: int = DEPTH) -> list[list[str]]:
    """All levels over the slots of a block, lowest first: `depth` of them above the slots or, of a lone block, until one node is left."""
    out = [digests]
    while len(out[-1]) > 1 if lone else len(out) <= depth:
        now = out[-1]
        out.append([_hash("".join(now[i : i + FAN])) for i in range(0, len(now), FAN)])
    return out


def path(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """For each level below the top: the digests of the siblings before and after what holds slot `at`."""
    out = []
    for now in levels[:-1]:
        first = at - at % FAN
        out.append(("".join(now[first:at]), "".join(now[at + 1 : first + FAN])))
        at //= FAN
    return out


def _slots(rows: pa.Table) -> list[str]:
    """Digests of a block by slot, of rows (at, n, digest)."""
    at, n = rows.column("at").to_pylist(), rows.column("n").to_pylist()
    out = [""] * (max(a + b for a, b in zip(at, n)))
    for a, b, d in zip(at, n, rows.column("digest").to_pylist()):
        out[a : a + b] = [d] * b
    return out


_STEPS = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


class Tree:
    """The trees of all groups over nodes (g, block, at, n, digest): node digests stand at n slots from `at` on.

    roots has (g, digest); paths(tops) has (g, block, steps, ..) for the blocks of the nodes, where tops
    (g, steps, ..) continues each group's path above its root.
    """

    def __init__(self, nodes: DataFrame, depth: int = DEPTH):
        self.depth, self.rounds, self.roots = depth, [], None
        size = FAN**depth
        while True:
            def reduce(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
                slots = _slots(rows)
                lone = levels(slots, True)[-1][0] if key[1].as_py() == 0 else None
                return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), pa.array([levels(slots, False, depth)[-1][0]]), pa.array([lone], pa.string())], names=["g", "place", "digest", "alone"])

            made = nodes.select("g", "block", "at", "n", "digest").groupBy("g", "block").applyInArrow(reduce, "g string, place long, digest string, alone string")
            made = materialize(made, "blocks")
            of = materialize(made.groupBy("g").agg(F.count(F.lit(1)).alias("blocks")), "sizes")
            single = made.join(of.where("blocks = 1"), "g").select("g", F.col("alone").alias("digest"))
            self.roots = single if self.roots is None else self.roots.unionByName(single)
            self.rounds.append((nodes, of))
            if of.where("blocks > 1").isEmpty():
                self.roots = materialize(self.roots, "roots")
                return
            more = join_counted(made, of.where("blocks > 1").withColumn("c", F.col("blocks")), ["g"], "c")
            nodes = materialize(more.select("g", F.floor(F.col("place") / size).alias("block"), (F.col("place") % size).cast("int").alias("at"), F.lit(1).alias("n"), "digest"), "nodes")

    def paths(self, tops: DataFrame) -> DataFrame:
        """(g, block, blocks, steps, ..tops' other columns) for each block of the lowest round."""
        extra = [c for c in tops.columns if c not in ("g", "steps")]
        kinds = "".join(f", {c} {tops.schema[c].dataType.simpleString()}" for c in extra)
        depth, size, above = self.depth, FAN**self.depth, None
        for i, (_, of) in reversed(list(enumerate(self.rounds))):
            here = of.where("blocks = 1").join(tops, "g").select("g", F.lit(0).cast("long").alias("block"), "blocks", "steps", *extra)
            if above is not None:
                nodes = self.rounds[i + 1][0]

                def down(rows: pa.Table, chain: pa.Table) -> pa.Table:
                    made = levels(_slots(rows), chain.column("blocks")[0].as_py() == 1, depth)
                    up = chain.column("steps")[0].as_py()
                    at = rows.column("at").to_pylist()
                    steps = [[{"l": a, "r": b} for a, b in path(made, x)] + up for x in at]
                    n = len(at)
                    same = [pa.repeat(chain.column(c)[0], n) for c in extra]
                    return pa.table([rows.column("g"), pa.array([b * size + x for b, x in zip(rows.column("block").to_pylist(), at)], pa.int64()), pa.array(steps, _STEPS), *same], names=["g", "block", "steps", *extra])

                lower = nodes.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(down, f"g string, block long, steps array<struct<l:string,r:string>>{kinds}")
                here = here.unionByName(lower.withColumn("blocks", F.lit(2).cast("long")))
            above = materialize(here, "paths")
        return above


def build(df: DataFrame, id_col: str, group: str, fields: list[str], changed: dict[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    A leaf is made of the fields in order. proof_sha256 is the digest of all siblings on the way to the
    root. folded_root is what they and the leaf give if the fields in `changed` hold its expressions
    instead; verified tells whether that is the root. depth makes no difference to the result.
    """
    changed = changed or {}
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # ordered as groups are: null first
    rows = df.select(name.alias("g"), F.col(id_col).cast("long").alias("k"), leaf([F.col(f) for f in fields]).alias("leaf"), leaf([changed.get(f, F.col(f)) for f in fields]).alias("now"))
    leaves = materialize(rows.groupBy("g", "k", "leaf", "now").agg(F.count(F.lit(1)).alias("n")), "leaves")
    size = FAN**depth
    placed = _places(leaves).withColumn("end", F.col("place") + F.col("n"))
    placed = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("place") / size), F.floor((F.col("end") - 1) / size))))
    first = F.greatest(F.lit(0), F.col("place") - F.col("block") * size)
    nodes = placed.select("g", "block", first.cast("int").alias("at"), (F.least(F.lit(size), F.col("end") - F.col("block") * size) - first).cast("int").alias("n"), F.col("leaf").alias("digest"), "k", "now")
    nodes = materialize(nodes, "nodes")
    trees = Tree(nodes, depth)

    ordered = positions(trees.roots, [], "g").withColumn("place", F.col("rn") - 1)
    upper = ordered.select(F.lit("").alias("g"), F.floor(F.col("place") / size).alias("block"), (F.col("place") % size).cast("int").alias("at"), F.lit(1).alias("n"), "digest", F.col("g").alias("of"))
    upper = materialize(upper, "groups")
    top = Tree(upper, depth)
    none = F.array().cast("array<struct<l:string,r:string>>")
    chains = top.paths(top.roots.select("g", none.alias("steps"), F.col("digest").alias("root")))

    def group_paths(rows: pa.Table, chain: pa.Table) -> pa.Table:
        made = levels(_slots(rows), chain.column("blocks")[0].as_py() == 1, depth)
        up, root = chain.column("steps")[0].as_py(), chain.column("root")[0]
        steps = [[{"l": a, "r": b} for a, b in path(made, x)] + up for x in rows.column("at").to_pylist()]
        return pa.table([rows.column("of"), pa.array(steps, _STEPS), rows.column("digest"), pa.repeat(root, rows.num_rows)], names=["g", "steps", "subroot", "root"])

    tops = upper.groupBy("g", "block").cogroup(chains.groupBy("g", "block")).applyInArrow(group_paths, "g string, steps array<struct<l:string,r:string>>, subroot string, root string")
    chains = trees.paths(materialize(tops, "tops"))
    kind = df.schema[id_col].dataType.simpleString()

    def prove(rows: pa.Table, chain: pa.Table) -> pa.Table:
        made = levels(_slots(rows), chain.column("blocks")[0].as_py() == 1, depth)
        up, subroot, root = (chain.column(c)[0].as_py() for c in ("steps", "subroot", "root"))
        up = [(s["l"], s["r"]) for s in up]
        above = "".join(a + b for a, b in up)
        ids, leaf_, proof, folded = [], [], [], []
        for k, at, n, digest, now in zip(*(rows.column(c).to_pylist() for c in ("k", "at", "n", "digest", "now")), strict=True):
            for slot in range(at, at + n):
                steps = path(made, slot)
                proof.append(_hash("".join(a + b for a, b in steps) + above))
                node = now
                for a, b in (*steps, *up):
                    node = _hash(a + node + b)
                ids.append(k)
                leaf_.append(digest)
                folded.append(node)
        n = len(ids)
        return pa.table([pa.array(ids, pa.int64()), pa.array(leaf_, pa.string()), *(pa.array([x] * n, pa.string()) for x in (subroot, root)), pa.array(proof, pa.string()), pa.array(folded, pa.string())], names=["k", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    out = nodes.groupBy("g", "block").cogroup(chains.groupBy("g", "block")).applyInArrow(prove, "k long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.select(F.col("k").cast(kind).alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
