"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to `max_order` bytes with counts of the byte that
followed. A byte costs -log2 of its probability under escape method C: in a context with total T
and D distinct successors a seen byte has c / (T + D), and the escape D / (T + D) hands on to the
next shorter context, down to the uniform 1 / 256. The statistics are frozen after fitting, so a
text's code length is exact and the same wherever it is scored; the shortest code names the language.

Fitting reads a bounded sample of distinct labelled texts per language: of about
`sample_per_language` texts, chosen by a hash of the text, those that come first until
`sample_bytes` are full, each whole and once however many rows have it. All languages together read
`sample_total` bytes, in equal shares where these are smaller, so what reaches the driver and is
broadcast does not grow with their number. Successor counts are summed in Spark. All contexts of the sample are kept. A language's tree stands in hash tables over its
contexts and successors, so the model grows with the sample and not with the number of languages
squared, and scoring looks bytes up by numpy, some 100,000 at a time.

Cases: a text that is null, empty or has no letters is `und` with score 0, and so is every text if no
labelled row exists; rows with null language or text teach nothing; ties go to the language that
sorts first. Repeated rows are scored each. Only the text takes part in a prediction. Very long texts
are scored whole, in chunks. An empty table gives an empty result. Other columns are kept, whatever
their names, and one named like an output is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgraph.llm.common import field, map_texts, raw_bytes
from reelgraph.llm.lookup import Lookup

UNDETERMINED = "und"
#: Languages that may be learned; more are an error, as each has its own trees.
MAX_LANGUAGES = 200
#: The bound on labelled text: distinct texts and their bytes, for each language.
SAMPLE_TEXTS, SAMPLE_BYTES = 1000, 4_000_000
#: The bound on the bytes of all languages.
SAMPLE_TOTAL = 32_000_000
_SCALE = 1 << 30
#: Bytes scored at a time.
_CHUNK = 1 << 17


def _padded(column, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with `order` line feeds before each text, starts, ends) of the texts within."""
    data, starts, ends = raw_bytes(column)
    shift = (np.arange(len(starts)) + 1) * order
    out = np.full(len(data) + order * len(starts), 10, np.uint8)
    out[np.arange(len(data)) + np.repeat(shift, ends - starts)] = data
    return out, starts + shift, ends + shift


def _codes(data: np.ndarray, order: int) -> np.ndarray:
    """Each run of order + 1 bytes as a number."""
    code = np.zeros(max(0, len(data) - order), np.uint64)
    for k in range(order + 1):
        code = code << np.uint64(8) | data[k : k + len(code)]
    return code


def successor_counts(df: DataFrame, text: str, lang: str, max_order: int) -> DataFrame:
    """(lang, gram, n): how often each run of max_order + 1 bytes ends inside a text; partially summed in the tasks."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(part):
        langs, grams, counts = [], [], []
        names = np.array(part.column("lang").to_pylist(), object)
        for name in dict.fromkeys(names.tolist()):
            data, starts, ends = _padded(part.column("text").filter(pa.array(names == name)), max_order)
            code = _codes(data, max_order)
            mark = np.zeros(len(data) + 1, np.int64)
            np.add.at(mark, starts, 1)
            np.add.at(mark, ends, -1)
            g, n = np.unique(code[np.cumsum(mark)[max_order:-1] > 0].view(np.int64), return_counts=True)
            langs += [name] * len(g)
            grams.append(g)
            counts.append(n)
        return [pa.array(langs, pa.string()), np.concatenate([*grams, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)]

    rows = map_texts(df.select(F.col(text).alias("text"), F.col(lang).alias("lang")), run, schema)
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """One language's contexts: for each order, the bits of successors and of escapes."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, order: int):
        self.order, self.seen, self.escape = order, [], []
        for d in range(order + 1):
            codes, at = np.unique(grams & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
            count = np.bincount(at, n, len(codes))
            context, of = np.unique(codes >> np.uint64(8), return_inverse=True)
            total, distinct = np.bincount(of, count, len(context)), np.bincount(of, minlength=len(context))
            self.seen.append(Lookup(codes, np.log2((total + distinct)[of] / count).astype(np.float32)))
            self.escape.append(Lookup(context, np.log2((total + distinct) / distinct).astype(np.float32)))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of each byte, given as the number of the run that ends with it."""
        out, left = np.zeros(len(codes)), np.arange(len(codes))
        for d in range(self.order, -1, -1):
            run = codes[left] & np.uint64((1 << 8 * (d + 1)) - 1)
            cost, hit = self.seen[d].get(run)
            out[left] += np.where(hit, cost, np.float32(0))
            left, run = left[~hit], run[~hit]
            if not len(left):
                return out
            cost, known = self.escape[d].get(run >> np.uint64(8))
            out[left] += np.where(known, cost, np.float32(0))
        out[left] += 8
        return out


class Model:
    """The trees of all languages."""

    def __init__(self, langs: list[str], grams: np.ndarray, lang_of: np.ndarray, n: np.ndarray, max_order: int):
        self.langs, self.order = langs, max_order
        self.trees = [Tree(grams[lang_of == i].view(np.uint64), n[lang_of == i], max_order) for i in range(len(langs))]

    def bits(self, column) -> np.ndarray:
        """Code length in bits of each text under each language."""
        data, starts, ends = _padded(column, self.order)
        out = np.zeros((len(starts), len(self.langs)))
        for at in range(0, len(data) - self.order, _CHUNK):
            codes = _codes(data[at : at + _CHUNK + self.order], self.order)
            place = np.arange(at + self.order, at + self.order + len(codes))
            doc = np.searchsorted(ends, place, "right")
            inside = (doc < len(starts)) & (place >= starts[np.minimum(doc, len(starts) - 1)])
            codes, doc = codes[inside], doc[inside]
            for i, tree in enumerate(self.trees):
                out[:, i] += np.bincount(doc, tree.bits(codes), len(starts))
        return out


def sample(rows: DataFrame, sizes: dict[str, int], texts: int, most_bytes: int) -> DataFrame:
    """Of each language's distinct texts about `texts` by a hash of the text, and of these the first that fill most_bytes (one at least, the shortest if none fits)."""
    share = F.create_map(*(x for k in sizes for x in (F.lit(k), F.lit(min(_SCALE, int(_SCALE * texts / sizes[k]) + 1)))))
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(_SCALE)) < F.element_at(share, F.col("lang"))).distinct()
    size = F.octet_length("text").cast("long")
    some = some.withColumns({"_size": size, "_fits": size <= most_bytes})
    order = [F.desc("_fits"), F.when(~F.col("_fits"), F.col("_size")), F.xxhash64("text"), "text"]
    by = Window.partitionBy("lang").orderBy(*order)  # a sample of bounded size, not a language
    some = some.withColumns({"_n": F.row_number().over(by), "_sum": F.sum("_size").over(by.rowsBetween(Window.unboundedPreceding, 0))})
    return some.where((F.col("_n") == 1) | (F.col("_fits") & (F.col("_sum") <= most_bytes))).select("lang", "text")


def fit(df: DataFrame, text: str = "text", lang: str = "lang", max_order: int = 3, sample_per_language: int = SAMPLE_TEXTS, sample_bytes: int = SAMPLE_BYTES, sample_total: int = SAMPLE_TOTAL) -> Model:
    """A Model from the labelled rows of df."""
    if not 1 <= max_order <= 6:
        raise ValueError("max_order must be 1 to 6")
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    distinct = rows.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min(F.lit(1)).alias("one"))
    sizes = {r["lang"]: r["count"] for r in distinct.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    langs = sorted(sizes)
    grams, lang_of, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if langs:
        # bounded by the sample: no more rows than it has bytes
        most_bytes = min(sample_bytes, sample_total // len(langs))
        table = successor_counts(sample(rows, sizes, sample_per_language, most_bytes), "text", "lang", max_order).toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
        grams = table.column("gram").to_numpy()
        lang_of = np.searchsorted(np.array(langs, object), np.array(table.column("lang").to_pylist(), object)) if len(grams) else lang_of
        n = table.column("n").to_numpy().astype(float)
    return Model(langs, grams, lang_of, n, max_order)


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's kept columns (None: all but those named like outputs) with lang_pred, score (0 to 1) and bits_per_byte."""
    own = ["lang_pred", "score", "bits_per_byte"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in own]
    schema = T.StructType([*(field(df, c) for c in keep), T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("bits_per_byte", T.DoubleType(), False)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(part):
        model, column = shared.value, part.column(text)
        letters = np.array([x is not None and any(map(str.isalpha, x)) for x in column.to_pylist()], bool)
        size = np.maximum(1, pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        if not model.langs:
            return [*(part.column(c) for c in keep), [UNDETERMINED] * len(letters), [0.0] * len(letters), [0.0] * len(letters)]
        bits = model.bits(column)
        best, least = bits.argmin(axis=1), bits.min(axis=1)
        score = 1 / np.exp2(np.maximum(-1000, least[:, None] - bits)).sum(axis=1)
        langs = [model.langs[i] if ok else UNDETERMINED for i, ok in zip(best, letters, strict=True)]
        return [*(part.column(c) for c in keep), langs, np.where(letters, score, 0.0), np.where(letters, least / size, 0.0)]

    return map_texts(df, run, schema, text, 1 << 19)
