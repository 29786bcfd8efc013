"""Suffix-array dedup: byte strings that repeat, found as intervals of common prefixes.

Each window start is dealt to the anchor of its window (see anchors.py), so equal windows meet in one
task wherever they stand, and windows whose anchor occurs once are left out beforehand. What travels
is a piece: consecutive window starts of one anchor, with the bytes of their windows. A task collapses
equal pieces, sorts the suffixes of the rest that begin a repeated window, computes the common
prefixes of neighbours, and scans them with a stack: each interval of the tree is a set of suffixes
with a common prefix. An interval whose occurrences are preceded by different bytes (or begin a piece)
cannot be extended to the left within its pieces; what it covers beside its earliest occurrence is
removed.

Maximal repeat groups go beyond pieces, so they are found apart (see maximal_repeats): window starts
whose windows are preceded by different bytes are the candidates, and the lengths at which the set of
occurrences changes are searched in rounds, for all candidates at once.

Removal keeps the earliest occurrence of each string of `width` bytes: by id, then position.

An anchor with more than `hot` occurrences would be a group too large for one task, so its pieces are
dealt by their own bytes instead, and the windows of distinct ones likewise: the interval of a window
is then a key, its earliest occurrence a minimum that is aggregated before the shuffle and joined back,
with frequent keys split (see skew.py). Intervals longer than a window are not needed for what is
removed, so the result is the same.

Cases: a null or empty text has no bytes; texts shorter than the window keep all; rows that share id
and text are one document (none is earlier than the other); of rows that share the id alone the
smaller text key counts as earlier; null ids come last; very long texts are cut into segments that
overlap by a window; an empty table gives an empty result; other columns are left out, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgraph.llm import anchors
from reelgraph.llm.common import byte_cuts, field, map_texts, materialize, raw_bytes, slices
from reelgraph.llm.cuts import cut, keyed
from reelgraph.llm.sieve import sift
from reelgraph.llm.skew import join_counted

#: Occurrences of an anchor above which its windows are dealt singly.
HOT = 40_000
#: Bytes of distinct pieces sorted at a time (more if one anchor has more).
CHUNK = 1 << 20


def _anchors(part, width: int):
    data, starts, ends = raw_bytes(part.column("text"))
    sums = anchors.prefix(anchors.byte_values(data))
    valid = anchors.inside(starts, ends, len(data), width)
    least, mask = anchors.window_anchors(sums, valid, width, anchor_bytes(width))
    sub = (anchors.windows(sums, anchor_bytes(width)) | np.uint64(1))[: len(mask)]
    return data, starts, ends, sums, valid, least, mask, sub


def anchor_bytes(width: int) -> int:
    return max(1, width * 2 // 5)


def anchor_counts(docs: DataFrame, width: int) -> DataFrame:
    """(h, n) of anchors that occur more than once."""

    def run(part):
        *_, mask, sub = _anchors(part, width)
        return [pa.array(sub[mask].view(np.int64))]

    rows = map_texts(docs, run, T.StructType([T.StructField("h", T.LongType(), False)]), cut=byte_cuts(width))
    return rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def anchor_rows(docs: DataFrame, width: int) -> DataFrame:
    """(h, id, key) of each anchor."""
    schema = T.StructType([T.StructField("h", T.LongType(), False), field(docs, "id"), T.StructField("key", T.LongType(), False)])

    def run(part):
        _, _, ends, _, _, _, mask, sub = _anchors(part, width)
        at = np.flatnonzero(mask)
        take = pa.array(np.searchsorted(ends, at, "right"))
        return [pa.array(sub[at].view(np.int64)), part.column("id").take(take), part.column("key").take(take)]

    return map_texts(docs, run, schema, cut=byte_cuts(width))


def pieces(docs: DataFrame, width: int, has, hot, want_hot: bool) -> DataFrame:
    """(h, id, key, start, n, again, piece): n window starts of anchor h from byte `start` on; again: h occurs twice in it. Either hot anchors or the others."""
    schema = T.StructType([
        T.StructField("h", T.LongType(), False), field(docs, "id"), T.StructField("key", T.LongType(), False), T.StructField("start", T.IntegerType(), False),
        T.StructField("n", T.IntegerType(), False), T.StructField("again", T.BooleanType(), False), T.StructField("piece", T.BinaryType(), False),
    ])
    reach = width - anchor_bytes(width)

    def run(part):
        data, starts, ends, _, valid, least, mask, sub = _anchors(part, width)
        at = np.flatnonzero(valid)
        at = at[has(part, least[at])]
        at = at[hot(part, least[at]) == want_hot]
        if not len(at):
            return [[], [], [], [], [], [], []]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])]))
        first, n = at[new], np.diff(np.append(new, len(at)))
        last, h = first + n - 1, least[first]
        where = np.flatnonzero(mask)
        same = np.flatnonzero(sub[where[1:]] == sub[where[:-1]])
        a, b = np.append(where[same], len(data) * 2 + 9), np.append(where[same + 1], len(data) * 4 + 9)
        again = b[np.searchsorted(a, first)] <= last + reach
        doc = np.searchsorted(ends, first, "right")
        size = n + width - 1
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        flat = data[np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], size)]
        piece = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        take = pa.array(doc)
        start = first - starts[doc] + part.column("base").to_numpy()[doc]
        return [pa.array(h.view(np.int64)), part.column("id").take(take), part.column("key").take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again), piece]

    return map_texts(docs, run, schema, cut=byte_cuts(width))


class SuffixArray:
    """Enhanced suffix array of the window starts of some pieces, as far as their windows repeat there.

    Suffixes are sorted by their first `depth` bytes, a quarter more than the window; a common prefix
    ends there, or where a piece does. A start whose window is alone has no common prefix to speak of.
    """

    def __init__(self, parts: list[bytes], counts: np.ndarray, width: int):
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(x) for x in parts])
        ends = np.cumsum(sizes).astype(np.int32)
        self.data, self.depth = data, -(-width * 5 // 32) * 8
        self.end = np.repeat(ends, sizes)
        self.begin = np.repeat(ends - sizes, sizes).astype(np.int32)
        self.piece = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        starts = np.flatnonzero(np.arange(len(data), dtype=np.int32) - self.begin < counts[self.piece])
        _, of, n = np.unique(anchors.windows(anchors.prefix(anchors.byte_values(data)), width)[starts], return_inverse=True, return_counts=True)
        starts = starts[n[of] > 1]
        eight = np.ndarray(len(data) + 1, ">u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))  # the bytes from each place on
        keys = np.zeros((len(starts), self.depth // 8), ">u8")
        for k in range(self.depth // 8):
            at = np.minimum(starts + 8 * k, len(data))
            left = np.clip(self.end[starts] - at, 0, 8).astype(np.uint64)  # nothing of the next piece
            drop = np.uint64(64) - np.uint64(8) * np.maximum(left, 1)
            keys[:, k] = np.where(left > 0, eight[at] >> drop << drop, 0)
        by = np.argsort(keys.view(f"S{self.depth}").ravel(), kind="stable") if len(starts) else np.zeros(0, np.int64)
        self.order = starts[by]
        self.common = self._common(keys[by].astype(np.uint64), width)

    def _common(self, keys: np.ndarray, width: int) -> np.ndarray:
        """Common prefix of each suffix with the one before it (0 where it is below the window)."""
        out = np.zeros(len(self.order), np.int64)
        if len(out) < 2:
            return out
        differ = keys[1:] != keys[:-1]
        word = np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])
        at = np.minimum(word, keys.shape[1] - 1)[:, None]
        x = (np.take_along_axis(keys[1:], at, 1) ^ np.take_along_axis(keys[:-1], at, 1)).ravel()
        same = sum((x < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
        size = np.where(word < keys.shape[1], 8 * word + same, self.depth)
        p, q = self.order[:-1], self.order[1:]
        size = np.minimum(size, np.minimum(self.end[p] - p, self.end[q] - q))
        out[1:] = np.where(size >= width, size, 0)
        return out

    def intervals(self) -> np.ndarray:
        """(from, to, common prefix) of the tree's intervals that cannot be extended to the left; to is inclusive."""
        common = self.common
        on = np.flatnonzero(common)
        first = on[np.concatenate([[True], np.diff(on) > 1])] if len(on) else on
        last = on[np.concatenate([np.diff(on) > 1, [True]])] if len(on) else on
        bounds = np.stack([first, last + 1], axis=1).ravel()
        least, most = (f.reduceat(np.append(common, 0), bounds)[::2] if len(on) else on for f in (np.minimum, np.maximum))
        flat = least == most  # a tree of one node; the others are scanned
        found = [np.stack([first[flat] - 1, last[flat], least[flat]], axis=1)]
        for a, b in zip(first[~flat].tolist(), last[~flat].tolist(), strict=True):
            nodes, stack = [], []
            for i, now in enumerate([*common[a : b + 1].tolist(), 0], a):
                left = i - 1
                while stack and stack[-1][0] > now:
                    size, left = stack.pop()
                    nodes.append((left, i - 1, size))
                if now and (not stack or stack[-1][0] < now):
                    stack.append((now, left))
            found.append(np.array(nodes, np.int64))
        found = np.concatenate(found)
        if not len(found):
            return np.zeros((0, 3), np.int64)
        at = self.order
        before = np.where(at > self.begin[at], self.data[np.maximum(at - 1, 0)].astype(np.int64), -1 - self.piece[at])
        change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
        # a prefix as long as the suffixes are sorted may go on, so what stands to its left does not tell
        return found[(change[found[:, 1]] > change[found[:, 0]]) | (found[:, 2] >= self.depth)]


#: Occurrences of intervals listed at a time.
_BLOCK = 1 << 20


def _collapse(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rank by id, key, start; the earliest row of each distinct piece; the later rows; those of the earliest whose pieces others of their anchor, or themselves, may overlap)."""
    keys = table.select(["id", "key", "start"])
    at = pc.sort_indices(keys, [("id", "ascending"), ("key", "ascending"), ("start", "ascending")])
    keys, differ = keys.take(at), np.zeros(max(0, table.num_rows - 1), bool)
    for name in keys.column_names:
        x = keys.column(name).combine_chunks()
        x, y = x[1:], x[:-1]
        alike = pc.or_kleene(pc.and_(pc.is_null(x), pc.is_null(y)), pc.fill_null(pc.equal(x, y), False))
        differ |= ~alike.to_numpy(zero_copy_only=False)
    order = np.empty(table.num_rows, np.int64)  # rows that share all three are one occurrence
    order[at.to_numpy()] = np.concatenate([[0], np.cumsum(differ)])[: table.num_rows]
    code = pc.dictionary_encode(table.column("piece").combine_chunks()).indices.to_numpy()  # a piece has one anchor
    by = np.lexsort((order, code))
    new = np.concatenate([[True], code[by[1:]] != code[by[:-1]]])
    later = ~new & np.concatenate([[True], order[by[1:]] != order[by[:-1]]])
    lead = by[new]
    _, of, n = np.unique(table.column("h").to_numpy()[lead], return_inverse=True, return_counts=True)
    again = table.column("again").to_numpy(zero_copy_only=False)[lead]
    return order, lead, by[later], lead[(n[of] > 1) | again]


class Tree:
    """The intervals over some distinct pieces, short prefixes first, with their earliest occurrences."""

    def __init__(self, table: pa.Table, order: np.ndarray, lead: np.ndarray, width: int):
        piece, count = table.column("piece"), table.column("n").to_numpy()[lead]
        self.array = SuffixArray([piece[int(i)].as_py() for i in lead], count, width)
        at = self.array.order
        self.rank = order[lead][self.array.piece[at]] << 32 | (at - self.array.begin[at]).astype(np.int64)
        nodes = self.array.intervals()
        self.nodes = nodes[np.argsort(nodes[:, 2], kind="stable")]
        bounds = np.stack([self.nodes[:, 0], self.nodes[:, 1] + 1], axis=1).ravel()
        self.first = np.minimum.reduceat(np.append(self.rank, np.iinfo(np.int64).max), bounds)[::2] if len(nodes) else np.zeros(0, np.int64)

    def occurrences(self):
        """(numbers of nodes, places in the suffix array, whether each is its node's earliest), some nodes at a time."""
        size = self.nodes[:, 1] - self.nodes[:, 0] + 1
        total = np.cumsum(size)
        at = 0
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _BLOCK, "right")))
            node = np.repeat(np.arange(at, end), size[at:end])
            place = np.arange(len(node)) - np.repeat(total[at:end] - size[at:end] - (total[at - 1] if at else 0), size[at:end]) + self.nodes[node, 0]
            yield node, place, self.rank[place] == self.first[node]
            at = end


def _named(table: pa.Table, schema: T.StructType, row, columns: dict) -> pa.RecordBatch:
    take = pa.array(row)
    columns |= {"id": table.column("id").take(take).combine_chunks(), "key": table.column("key").take(take).combine_chunks()}
    columns["start"] = pa.array((table.column("start").to_numpy()[row] + columns["start"]).astype(np.int32))
    if "end" in columns:
        columns["end"] = pa.array((table.column("start").to_numpy()[row] + columns["end"]).astype(np.int32))
    return pa.RecordBatch.from_arrays([columns[k] for k in schema.names], names=schema.names)


def _removed(table: pa.Table, width: int, schema: T.StructType):
    """(id, key, start, end) runs of bytes that maximal repeats cover at other occurrences than their earliest."""
    order, _, row, some = _collapse(table)
    length = pc.binary_length(table.column("piece")).to_numpy()
    if len(row):
        yield _named(table, schema, row, {"start": np.zeros(len(row), np.int32), "end": length[row]})
    if not len(some):
        return
    tree = Tree(table, order, some, width)
    array = tree.array
    reach = np.zeros(len(array.order), np.int32)
    for node, place, is_first in tree.occurrences():  # long prefixes come later and stay
        reach[place[~is_first]] = tree.nodes[node[~is_first], 2]
    hit = np.flatnonzero(reach)
    if not len(hit):
        return
    change = np.zeros(len(array.data) + 1, np.int32)
    np.add.at(change, array.order[hit], 1)
    np.add.at(change, array.order[hit] + reach[hit], -1)
    inside = np.cumsum(change)[:-1] > 0
    # a run ends with its piece
    a = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | (np.arange(len(inside)) == array.begin)))
    b = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | (np.arange(1, len(inside) + 1) == array.end))) + 1
    yield _named(table, schema, some[array.piece[a]], {"start": a - array.begin[a], "end": b - array.begin[a]})


def _by_anchor(rows: DataFrame, schema: T.StructType, width: int, done) -> DataFrame:
    """done() over whole anchor groups, about CHUNK bytes of pieces at a time."""

    def run(batches):
        held, size = [], 0
        for batch in (part for whole in batches for part in slices(whole, "piece", CHUNK // 2)):
            held.append(batch)
            size += batch.nbytes
            if size < CHUNK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            h = table.column("h").to_numpy()
            cut_at = int(np.searchsorted(h, h[-1]))  # the last anchor may go on in the next batch
            if cut_at:
                yield from done(table.slice(0, cut_at), width, schema)
                held = table.slice(cut_at).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held) if cut_at else size // 2
        if held:
            yield from done(pa.Table.from_batches(held).combine_chunks(), width, schema)

    dealt = rows.select("h", "id", "key", "start", "n", "again", "piece").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, schema)


def _found(df: DataFrame, id_col: str, text: str, width: int, hot: int, max_keys: int | None) -> tuple[DataFrame, DataFrame | None]:
    """(pieces of ordinary anchors, spans of hot ones)."""
    docs = keyed(df, id_col, text)
    counted = materialize(anchor_counts(docs, width), "anchors")
    many = counted.where(F.col("n") > hot)
    texts = docs
    docs, has = sift(texts, counted, lambda: anchor_rows(texts, width), max_keys)
    if many.isEmpty():
        return pieces(docs, width, has, lambda part, h: np.zeros(len(h), bool), False), None
    docs, is_hot = sift(docs, many, lambda: anchor_rows(texts, width), max_keys, "hot")
    return pieces(docs, width, has, is_hot, False), _hot_repeats(pieces(docs, width, has, is_hot, True), width)


def starts(docs: DataFrame, has, width: int) -> DataFrame:
    """(w, id, key, start, left, room): window starts with seen anchors; left is the byte before (-1: none), and no repeat goes on for more than room bytes."""
    schema = T.StructType([
        T.StructField("w", T.LongType(), False), field(docs, "id"), T.StructField("key", T.LongType(), False), T.StructField("start", T.IntegerType(), False),
        T.StructField("left", T.IntegerType(), False), T.StructField("room", T.IntegerType(), False),
    ])

    def run(part):
        data, begin, ends, sums, valid, least, *_ = _anchors(part, width)
        at = np.flatnonzero(valid)
        at = at[has(part, least[at])]
        if not len(at):
            return [[], [], [], [], [], []]
        doc = np.searchsorted(ends, at, "right")
        stop = np.flatnonzero(np.concatenate([(at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]), [True]]))
        last = at[stop[np.searchsorted(stop, np.arange(len(at)))]]
        left = np.where(at > begin[doc], data[np.maximum(at - 1, 0)].astype(np.int32), -1)
        take = pa.array(doc)
        return [pa.array(anchors.windows(sums, width)[at].view(np.int64)), part.column("id").take(take), part.column("key").take(take), pa.array((at - begin[doc]).astype(np.int32)), pa.array(left.astype(np.int32)), pa.array((last + width - at).astype(np.int32))]

    return map_texts(docs, run, schema)


#: Parts into which a round cuts each range of lengths.
_PARTS = 16
#: Occurrences that are preceded by different bytes, or one of which begins its document.
_LEFT = "min(left) = -1 OR min(left) <> max(left)"


def maximal_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 100, hot: int = HOT) -> DataFrame:
    """(repeat, length, id, key, start, first): all occurrences (byte offsets) of each maximal repeat group, the earliest marked.

    A group is a string of `width` bytes or more that occurs twice at least, and of whose occurrences
    neither all are preceded nor all are followed by the same byte. Windows before which the same byte
    always stands begin none, and neither does any longer string there, so few starts are left. A start
    belongs to a longest string of each of its sets of occurrences; the first round compares prefixes
    at doubling lengths, and each further one cuts the ranges in which a set changes in _PARTS, until
    they are one byte wide. Sets are told by MD5 and counted before they are joined back, frequent ones
    split (see skew.py), so `hot` makes no difference here.
    """
    docs = materialize(keyed(df, id_col, text).dropDuplicates(["id", "key"]), "documents")
    single = starts(*sift(docs, materialize(anchor_counts(docs, width), "anchors"), lambda: anchor_rows(docs, width)), width)
    many = single.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.expr(_LEFT).alias("diverse")).where("n > 1 AND diverse").drop("diverse")
    state = join_counted(single, materialize(many, "windows"), ["w"]).drop("w")
    texts = docs.select(F.col("id").alias("i"), F.col("key").alias("k"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    grid = [(width - 1 + (1 << j), min(width - 1 + (2 << j), 2**31 - 1)) for j in range(30)]
    ranges = F.array(*(F.struct(F.lit(a).alias("size"), F.lit(b).alias("next")) for a, b in grid))
    out = None
    while True:
        rows = materialize(_prefixes(state, texts, ranges), "prefixes")
        rank = F.struct(F.col("id").isNull().alias("none"), "id", "key", "start")
        sets = rows.groupBy("size", "next", "h").agg(
            F.count(F.lit(1)).alias("n"), F.expr(_LEFT).alias("diverse"), (F.count("after") < F.count(F.lit(1))).alias("ends"), (F.min("after") != F.max("after")).alias("parts"), F.min(rank).alias("least"),
        )
        sets = materialize(sets.where("n > 1 AND diverse AND (ends OR parts)").select("size", "next", "h", "n", "least"), "sets")
        found = materialize(_digests(sets.where("next = size + 1"), texts), "repeats")
        whole = join_counted(rows.where("next = size + 1").drop("left", "room", "next", "after"), found, ["size", "h"])
        is_first = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("key") == F.col("least.key")) & (F.col("start") == F.col("least.start"))
        whole = whole.select("repeat", F.col("size").alias("length"), "id", "key", "start", is_first.alias("first"))
        out = whole if out is None else out.unionByName(whole)
        wide = sets.where("next > size + 1").drop("least")
        if wide.isEmpty():
            return out
        state = join_counted(rows.where("next > size + 1").drop("after"), wide, ["size", "next", "h"]).select("id", "key", "start", "left", "room", F.col("size").alias("lo"), F.col("next").alias("hi"))
        step = F.ceil((F.col("hi") - F.col("lo")) / F.lit(_PARTS)).cast("int")
        ranges = F.transform(F.sequence(F.col("lo"), F.col("hi") - 1, step), lambda x: F.struct(x.alias("size"), F.least(x + step, F.col("hi")).alias("next")))


def _prefixes(state: DataFrame, texts: DataFrame, ranges) -> DataFrame:
    """(id, key, start, left, room, size, next, h, after): MD5 of the prefixes of both lengths of each range; after is null beyond room."""
    digest = lambda n: F.unhex(F.md5(F.substring("bytes", F.col("start") + 1, n)))
    within = F.filter(ranges, lambda x: x.getField("size") <= F.col("room"))
    made = F.transform(within, lambda x: F.struct(
        x.getField("size").alias("size"), x.getField("next").alias("next"), digest(x.getField("size")).alias("h"),
        F.when(x.getField("next") <= F.col("room"), digest(x.getField("next"))).alias("after"),
    ))
    rows = state.join(texts, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")))
    return rows.select("id", "key", "start", "left", "room", made.alias("made")).select("id", "key", "start", "left", "room", F.explode("made").alias("m")).select("id", "key", "start", "left", "room", "m.*")


def _digests(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(size, h, n, least, repeat): repeat is XXH64 of the string."""

    def run(part):
        names = [xxhash.xxh64_intdigest(x) for x in part.column("w").to_pylist()]
        return [part.column("size"), part.column("h"), pa.array(np.array(names, np.uint64).view(np.int64))]

    rows = sets.join(texts, F.col("least.id").eqNullSafe(F.col("i")) & (F.col("least.key") == F.col("k"))).select("size", "h", F.substring("bytes", F.col("least.start") + 1, F.col("size")).alias("w"))
    schema = T.StructType([T.StructField("size", T.IntegerType(), False), T.StructField("h", T.BinaryType()), T.StructField("repeat", T.LongType(), False)])
    return sets.join(map_texts(rows, run, schema, "w"), ["size", "h"]).select("size", "h", "n", "least", "repeat")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 100, hot: int = HOT, max_keys: int | None = None) -> DataFrame:
    """(id, key, start, end): runs of bytes that occur earlier; they may overlap."""
    rows, hot_rows = _found(df, id_col, text, width, hot, max_keys)
    schema = T.StructType([field(rows, "id"), T.StructField("key", T.LongType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)])
    out = _by_anchor(rows, schema, width, _removed)
    return out if hot_rows is None else out.unionByName(hot_rows)


def _hot_repeats(rows: DataFrame, width: int) -> DataFrame:
    """(id, key, start, end) of what occurs earlier among pieces of hot anchors.

    Equal pieces are told by their digest first: all but the earliest go whole. Of the earliest ones
    the windows are taken singly, and told likewise. Both minima are aggregated before the shuffle.
    """
    digest = lambda x: {"a": F.xxhash64(x), "b": F.unhex(F.md5(x))}
    held = materialize(rows.select("id", "key", "start", "n", "piece").withColumns(digest("piece")), "hot")
    whole = _marked(held, ["a", "b"], 1)
    later = whole.where("not first").select("id", "key", "start", (F.col("start") + F.col("n") + (width - 1)).alias("end"))
    single = whole.where("first").select("id", "key", "start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "piece")
    single = single.select("id", "key", (F.col("start") + F.col("i")).alias("start"), F.substring("piece", F.col("i") + 1, F.lit(width)).alias("w"))
    single = materialize(single.withColumns(digest("w")).drop("w"), "windows")
    again = _marked(single, ["a", "b"], 2).where("not first")
    return later.unionByName(again.select("id", "key", "start", (F.col("start") + width).alias("end")))


def _marked(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """rows whose key has `least` rows at least, with first: whether a row is the earliest of its key (a null id sorts last)."""
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "key", "start")
    counted = rows.groupBy(*keys).agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= least)
    is_first = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("key") == F.col("least.key")) & (F.col("start") == F.col("least.start"))
    return join_counted(rows, materialize(counted, "first"), keys, n="_rows").withColumn("first", is_first).drop("least")


def remove_bytes(text: str, runs: list[tuple[int, int]]) -> tuple[list[int], bytes]:
    data = text.encode()
    out, at, removed = [], 0, 0
    for a, b in runs:
        out.append(data[at:a])
        removed += b - a
        at = b
    return [len(data), removed, len(runs)], b"".join([*out, data[at:]])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 100, hot: int = HOT, max_keys: int | None = None) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept): kept holds the remaining bytes.

    max_keys: number of repeated anchors above which they are joined to the documents instead of broadcast (see sieve.py).
    """
    found = repeated_spans(df, id_col, text, width, hot, max_keys)
    spans = found.groupBy("id", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return cut(df, spans, id_col, text, remove_bytes, T.StructField("kept", T.BinaryType(), False), ["n_bytes", "n_removed", "n_spans"], max_keys)
