"""Substring dedup over words: windows of a fixed number of words that occur more than once go.

Words are runs between ASCII white space, unchanged. Rabin-Karp hashes of every window that may
repeat are counted in Spark; the windows that repeat merge into maximal intervals, all of whose words
are removed from every occurrence, the first included. Windows are judged on the input.

Two things thin out the work without losing a window. A pass over all texts counts anchors (see
anchors.py) and rules out windows that cannot repeat. Counts are summed in the tasks before their
shuffle, and in the join back frequent windows are split (see skew.py), so one that a third of all
documents share is never gathered.

Words are hashed by a mix of 64 bits, windows by two polynomials of these modulo 2**61 - 1: 122 bits.
Among n windows two different ones are taken for equal with a chance of about n * n * 35**2 / 2**123
(below 1e-8 for the 2e13 windows of 100 TB). Two different words of one hash (n * n / 2**65 among n
distinct words) do harm only where the other 34 words of a window agree as well.

Cases: a null or empty text has no words; a text shorter than a window keeps its words; repeated rows
are documents of their own and so repeat each other's windows; of windows that are equal none counts
as the better one, so ties do not arise; a null id is a value like any other; very long texts are
hashed in segments and cut block by block; an empty table gives an empty result; other columns are
left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgraph.llm import anchors
from reelgraph.llm.common import SLICE_BYTES, field, map_texts, materialize, raw_bytes, word_blocks, word_cuts
from reelgraph.llm.cuts import cut, keyed
from reelgraph.llm.sieve import sift
from reelgraph.llm.skew import join_counted

_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False


def _anchors(part, width: int):
    """(word hashes, first word of each text, valid windows, anchor of each window, anchor places, hashes of sub-windows)."""
    hashes, first, last = anchors.word_hashes(*raw_bytes(part.column("text")), _SOLID)
    sums = anchors.prefix(hashes)
    valid = anchors.inside(first, last, len(hashes), width)
    least, mask = anchors.window_anchors(sums, valid, width, anchor_words(width))
    return hashes, first, last, valid, least, mask, sums


def window_rows(docs: DataFrame, width: int, has) -> DataFrame:
    """(h1, h2, id, key, pos) of each window whose anchor may repeat."""
    schema = T.StructType([
        T.StructField("h1", T.LongType(), False), T.StructField("h2", T.LongType(), False), field(docs, "id"), T.StructField("key", T.LongType(), False), T.StructField("pos", T.LongType(), False),
    ])

    def run(part):
        hashes, first, last, valid, least, *_ = _anchors(part, width)
        at = np.flatnonzero(valid)
        at = at[has(part, least[at])]
        if not len(at):
            return [[], [], [], [], []]
        doc = np.searchsorted(last, at, "right")
        h1, h2 = anchors.window_keys(hashes, width)
        take = pa.array(doc)
        pos = at - first[doc] + part.column("base").to_numpy()[doc]
        return [pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)), part.column("id").take(take), part.column("key").take(take), pa.array(pos)]

    return map_texts(docs, run, schema, cut=word_cuts(width))


def anchor_words(width: int) -> int:
    return max(1, width // 2)


def anchor_rows(docs: DataFrame, width: int) -> DataFrame:
    """(h, id, key) of each anchor."""
    schema = T.StructType([T.StructField("h", T.LongType(), False), field(docs, "id"), T.StructField("key", T.LongType(), False)])

    def run(part):
        _, _, last, _, _, mask, sums = _anchors(part, width)
        at = np.flatnonzero(mask)
        take = pa.array(np.searchsorted(last, at, "right"))
        sub = anchors.windows(sums, anchor_words(width))[at] | np.uint64(1)
        return [pa.array(sub.view(np.int64)), part.column("id").take(take), part.column("key").take(take)]

    return map_texts(docs, run, schema, cut=word_cuts(width))


def anchor_counts(docs: DataFrame, width: int) -> DataFrame:
    """(h, n) of anchors that occur more than once."""

    def run(part):
        *_, mask, sums = _anchors(part, width)
        return [pa.array((anchors.windows(sums, anchor_words(width)) | np.uint64(1))[: len(mask)][mask].view(np.int64))]

    rows = map_texts(docs, run, T.StructType([T.StructField("h", T.LongType(), False)]), cut=word_cuts(width))
    return rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 35, max_keys: int | None = None) -> DataFrame:
    """(id, key, spans array<struct<start,end>>) of each document with repeated windows; spans count words and may overlap.

    max_keys: number of repeated anchors above which they are joined to the documents instead of broadcast (see sieve.py).
    """
    docs = keyed(df, id_col, text)
    again = materialize(anchor_counts(docs, width), "anchors")
    docs, has = sift(docs, again, lambda: anchor_rows(docs, width), max_keys)
    rows = window_rows(docs, width, has)
    again = materialize(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "windows")
    hits = join_counted(rows, again, ["h1", "h2"])
    return hits.groupBy("id", "key").agg(F.collect_set("pos").alias("pos")).select("id", "key", F.transform("pos", lambda p: F.struct(p.alias("start"), (p + width).alias("end"))).alias("spans"))


def remove_words(text: str, runs: list[tuple[int, int]], limit: int = SLICE_BYTES) -> tuple[list[int], str]:
    """([words, words removed], the rest joined by spaces); runs do not overlap."""
    n = removed = i = 0
    out = []
    for block in word_blocks(text.encode(), limit):
        words = block.split()
        at, end = 0, len(words)
        while i < len(runs) and runs[i][0] < n + end:
            a, b = max(0, runs[i][0] - n), min(end, runs[i][1] - n)
            out += words[at:a]
            removed += b - a
            at = b
            if runs[i][1] > n + end:  # it goes on in the next block
                break
            i += 1
        out += words[at:]
        n += end
    return [n, removed], b" ".join(out).decode()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 35, max_keys: int | None = None) -> DataFrame:
    """(id_col, n_words, n_removed, kept): kept is the text's remaining words, joined by one space."""
    spans = repeated_spans(df, id_col, text, width, max_keys)
    return cut(df, spans, id_col, text, remove_words, T.StructField("kept", T.StringType(), False), ["n_words", "n_removed"], max_keys)
