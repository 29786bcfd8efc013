"""Benchmark decontamination by a distributed positional inverted index.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters; a term is the 64-bit
hash of a word. Test items are cut into windows of consecutive terms. The postings (term, document,
position) of the rarest terms of each window, by their count over the whole corpus, are stored; lists
of two such terms are intersected after each position is adjusted by the term's place in the item.
What agrees names a document, an item and an alignment; the positions of all terms of the windows there
are then fetched from those documents and intersected likewise, which leaves exact phrases. A window
with a term that the corpus lacks is dropped at once. Proximity matches allow each term to stand up to
a slop off its place.

What is broadcast are Bloom filters of terms and of documents, of bounded size; they only thin out
postings that no intersection could use. Where a set is too large for a filter, all postings are taken.

Cases: null, empty or wordless documents and items have no terms; an item shorter than a window is one
window; of two equally rare terms the earlier in the item is taken; repeated rows are judged each;
items that share an id count once; an empty benchmark hits nothing, and an empty table gives an empty
result; null item ids are left out; very long texts are indexed in segments; other columns are left
out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgraph.llm import anchors, bloom
from reelgraph.llm.common import field, map_texts, materialize, raw_bytes, word_cuts
from reelgraph.llm.cuts import keyed

_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_POSTING = T.StructType([T.StructField("pos", T.IntegerType(), False), T.StructField("term", T.LongType(), False)])


def _terms(part):
    """(terms, first, end) of each text."""
    data, starts, ends = raw_bytes(part.column("text"))
    return anchors.word_hashes(_LOWER[data], starts, ends, _SOLID)


def _count(block: bytes) -> int:
    """Words of a block."""
    inner = _SOLID[np.frombuffer(block, np.uint8)]
    return int((inner[1:] & ~inner[:-1]).sum()) + int(bool(len(inner) and inner[0]))


def term_counts(docs: DataFrame, wanted) -> DataFrame:
    """(term, n) over all documents, of the terms in a Bloom filter (None: of all); summed in the tasks first."""
    schema = T.StructType([T.StructField("term", T.LongType(), False), T.StructField("n", T.LongType(), False)])

    def run(part):
        terms, _, _ = _terms(part)
        found, n = np.unique(terms if wanted is None else terms[wanted.value.has(terms)], return_counts=True)
        return [pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))]

    return map_texts(docs, run, schema, cut=word_cuts(1)).groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, wanted) -> DataFrame:
    """(term, id, key, pos) of the terms in a Bloom filter (None: of all)."""
    schema = T.StructType([T.StructField("term", T.LongType(), False), field(docs, "id"), T.StructField("key", T.LongType(), False), T.StructField("pos", T.IntegerType(), False)])

    def run(part):
        terms, first, last = _terms(part)
        at = np.flatnonzero(wanted.value.has(terms)) if wanted is not None else np.arange(len(terms))
        doc = np.searchsorted(last, at, "right")
        take = pa.array(doc)
        pos = at - first[doc] + part.column("base").to_numpy()[doc]
        return [pa.array(terms[at].view(np.int64)), part.column("id").take(take), part.column("key").take(take), pa.array(pos.astype(np.int32))]

    return map_texts(docs, run, schema, cut=word_cuts(1, _count))


def document_postings(docs: DataFrame, wanted, in_documents) -> DataFrame:
    """(id, key, n_words, postings): one row a document; postings only for documents in a Bloom filter (None: all)."""
    schema = T.StructType([field(docs, "id"), T.StructField("key", T.LongType(), False), T.StructField("n_words", T.LongType(), False), T.StructField("postings", T.ArrayType(_POSTING, False))])

    def run(part):
        terms, first, last = _terms(part)
        keys = part.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
        lengths = last - first
        keep = np.repeat(np.ones(len(keys), bool) if in_documents is None else in_documents.value.has(keys), lengths)
        if wanted is not None:
            keep[keep] = wanted.value.has(terms[keep])
        pos = (np.arange(len(terms)) - np.repeat(first, lengths))[keep].astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(keep)])
        offsets = np.concatenate([[0], ends[last]]).astype(np.int32)
        fields = [pa.field("pos", pa.int32(), False), pa.field("term", pa.int64(), False)]
        values = pa.StructArray.from_arrays([pa.array(pos), pa.array(terms[keep].view(np.int64))], fields=fields)
        listed = pa.ListArray.from_arrays(pa.array(offsets), values, type=pa.list_(pa.field("element", values.type, False)))
        return [part.column("id"), part.column("key"), pa.array(lengths.astype(np.int64)), listed]

    return map_texts(docs, run, schema)


class Index:
    """The benchmark's windows and the stored postings of their rarest terms."""

    def __init__(self, documents: DataFrame, benchmark: DataFrame, id_col: str, text: str, item_col: str, item_text: str, window: int, max_keys: int | None = None):
        self.window, self.max_keys, self.docs = window, max_keys, keyed(documents, id_col, text)
        items = keyed(benchmark.where(F.col(item_col).isNotNull()), item_col, item_text).distinct()
        items = materialize(postings(items, None).select("term", F.col("id").alias("item"), F.col("key").alias("item_key"), F.col("pos").alias("ipos")), "items")
        self.terms = bloom.build(items.select("term").distinct(), "term", max_keys=max_keys)
        counts = materialize(term_counts(self.docs, self.terms), "counts")
        # terms of an item in order; an item's list is bounded by the item
        place = F.struct("ipos", F.coalesce("n", F.lit(0)).alias("n"), "term")
        lists = items.join(counts, "term", "left").groupBy("item", "item_key").agg(F.array_sort(F.collect_list(place)).alias("terms"))
        self.items = materialize(items, "items")
        width = F.least(F.lit(window), F.size("terms"))
        spans = lists.withColumn("wpos", F.explode(F.sequence(F.lit(0), F.size("terms") - width))).withColumn("words", F.slice("terms", F.col("wpos") + 1, width))
        rare = F.array_sort(F.transform("words", lambda w: F.struct(w.getField("n").alias("n"), w.getField("ipos").alias("ipos"), w.getField("term").alias("term"))))
        spans = spans.withColumn("rare", rare).where(F.col("rare")[0]["n"] > 0)
        pick = lambda i: F.struct(F.get("rare", i).getField("ipos").alias("ipos"), F.get("rare", i).getField("term").alias("term"))
        self.windows = materialize(spans.select("item", "item_key", "wpos", F.size("words").alias("width"), pick(F.lit(0)).alias("p1"), pick(F.least(F.lit(1), F.size("rare") - 1)).alias("p2")), "windows")
        pivots = self.windows.select("item", "item_key", F.explode(F.array("p1", "p2")).alias("p")).select("item", "item_key", "p.ipos", "p.term").distinct()
        wanted = bloom.build(pivots.select("term").distinct(), "term", max_keys=max_keys)
        self.postings = materialize(postings(self.docs, wanted), "postings")
        #: each posting under each place that its term has in an item, with the alignment that follows
        self.aligned = self.postings.join(pivots, "term").select("item", "item_key", "ipos", "id", "key", (F.col("pos") - F.col("ipos")).alias("delta"))

    def _pairs(self) -> DataFrame:
        return self.windows.select("item", "item_key", F.col("p1.ipos").alias("i1"), F.col("p2.ipos").alias("i2")).distinct()

    def _met(self, slop: int) -> DataFrame:
        """Alignments (item, id, key, i1, i2, delta, other) where both rarest terms of a window stand, up to a slop apart."""
        first = self.aligned.withColumnRenamed("ipos", "i1").join(self._pairs(), ["item", "item_key", "i1"])
        second = self.aligned.select("item", "item_key", F.col("ipos").alias("i2"), F.col("id").alias("id2"), "key", F.col("delta").alias("other"))
        if not slop:
            second = second.withColumn("delta", F.col("other"))
            met = first.join(second, ["item", "item_key", "i2", "key", "delta"])
        else:
            met = first.join(second, ["item", "item_key", "i2", "key"]).where(F.abs(F.col("delta") - F.col("other")) <= slop)
        return met.where(F.col("id").eqNullSafe(F.col("id2"))).drop("id2")

    def proximity(self, slop: int = 5) -> DataFrame:
        """(id, key, item, wpos, delta, moved) of windows all of whose terms stand in a document within slop words of their places, but not all at them.

        Places follow from an occurrence of the window's rarest term: delta is where the item's first
        word would stand. wpos is where the window begins in the item, moved the number of terms that
        are off their places. Exact phrases are left to phrases(), whatever else is near.
        """
        window = ["item", "item_key", "wpos"]
        sides = self.windows.select(*window, "width", F.col("p1.ipos").alias("i1"), F.col("p2.ipos").alias("i2"))
        met = self._met(slop).select("item", "item_key", "i1", "i2", "id", "key", "delta").distinct().join(sides, ["item", "item_key", "i1", "i2"])
        met = materialize(met.select(*window, "width", "id", "key", "delta").distinct(), "near")
        keys = bloom.build(met.select("key").distinct(), "key", max_keys=self.max_keys)
        docs = document_postings(self.docs, self.terms, keys).where(F.size("postings") > 0)
        found = docs.select("key", F.col("id").alias("i"), F.explode("postings").alias("p")).select("key", "i", "p.pos", F.col("p.term").alias("term")).distinct()
        wanted = met.join(self.items, ["item", "item_key"]).where("ipos >= wpos AND ipos < wpos + width")
        off = F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("off")
        wanted = wanted.select(*window, "width", "id", "key", "delta", "ipos", "term", off).withColumn("pos", F.col("delta") + F.col("ipos") + F.col("off"))
        near = wanted.join(found, ["key", "pos", "term"]).where(F.col("id").eqNullSafe(F.col("i")))
        near = near.groupBy(*window, "width", "id", "key", "delta", "ipos").agg(F.min(F.abs("off")).alias("off"))
        whole = near.groupBy(*window, "width", "id", "key", "delta").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("off") > 0).alias("moved"))
        return whole.where("n = width AND moved > 0").select("id", "key", "item", "wpos", "delta", "moved")

    def phrases(self) -> DataFrame:
        """(id, key, n_words, hits): hits are array<struct<item,start,end>> of all exact occurrences of windows, null where there is none."""
        met = materialize(self._met(0).select("item", "item_key", "id", "key", "delta").distinct(), "alignments")
        keys = bloom.build(met.select("key").distinct(), "key", max_keys=self.max_keys)
        docs = materialize(document_postings(self.docs, self.terms, keys), "documents")
        found = docs.where(F.size("postings") > 0).select("id", "key", F.explode("postings").alias("p")).select("id", "key", "p.pos", "p.term").distinct()
        wanted = met.join(self.items, ["item", "item_key"]).select("item", "item_key", F.col("id").alias("i"), F.col("key").alias("k"), "delta", "ipos", F.col("term").alias("t"))
        stands = wanted.join(found, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("pos") == F.col("delta") + F.col("ipos")) & (F.col("term") == F.col("t")))
        # a window occurs where as many neighbouring places of the item agree as it has terms
        by = Window.partitionBy("item", "item_key", "id", "key", "delta").orderBy("ipos")
        run = stands.select("item", "item_key", "id", "key", "delta", "ipos", (F.col("ipos") - F.row_number().over(by)).alias("run"))
        runs = run.groupBy("item", "item_key", "id", "key", "delta", "run").agg(F.min("ipos").alias("from"), F.max("ipos").alias("to"))
        sizes = self.windows.groupBy("item", "item_key").agg(F.max("width").alias("width"))
        runs = runs.join(sizes, ["item", "item_key"]).where(F.col("to") - F.col("from") + 1 >= F.col("width"))
        hit = F.struct("item", (F.col("delta") + F.col("from")).alias("start"), (F.col("delta") + F.col("to") + 1).alias("end"))
        hits = runs.groupBy(F.col("id").alias("i"), F.col("key").alias("k")).agg(F.collect_set(hit).alias("hits"))
        return docs.select("id", "key", "n_words").join(hits, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left").select("id", "key", "n_words", "hits")


def covered(spans: str) -> F.Column:
    """Words covered by an array<struct<item,start,end>> (native; null: 0)."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.getField("start").alias("start"), s.getField("end").alias("end"))))
    total = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            (a.getField("n") + F.greatest(F.lit(0), s.getField("end") - F.greatest(s.getField("start"), a.getField("at")))).alias("n"),
            F.greatest(a.getField("at"), s.getField("end")).alias("at"),
        ),
        lambda a: a.getField("n"),
    )
    return F.coalesce(total, F.lit(0)).cast("long")


def find(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, max_keys: int | None = None) -> DataFrame:
    """(id_col, key, n_words, n_hit, items, contaminated) of each document; items are the ids whose windows occur, sorted as strings."""
    found = Index(documents, benchmark, id_col, text, item_col, item_text, window, max_keys).phrases()
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h.getField("item").cast("string"))))
    out = found.select(F.col("id").alias(id_col), "key", "n_words", covered("hits").alias("n_hit"), F.coalesce(items, F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
