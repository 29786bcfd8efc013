"""Groups of spelling variants: pairs of words one edit apart, found by PartEnum signatures of their letters.

The multiset of a word's letters is a binary vector with a place for the i-th occurrence of each letter.
Two words of one length that differ in one letter lie at Hamming distance two, and a word and the same
word with one letter more at distance one. The letters are partitioned into PARTS classes, so at most
two (one) of them differ, and each choice of the other classes gives a signature: what the vector holds
there. An edit also leaves the first or the second half of a word as it was, so each signature is made
twice, with the one half and with the other. Signatures are exact: words one edit apart share one.
They meet by an equi-join, and the edit distance of each pair that meets is taken.

All of it is DataFrame functions. The rows of a signature are joined, not gathered, so no task holds a
group; what is gathered are the near words of one word, of which there are no more than edits of it.

Cases: a null text has no words; a null id counts as an empty one; repeated rows are counted each; very
long texts give an array of their runs at a time; an empty table gives an empty result. Words are told
by their code points, without any normal form. Of equally frequent near words the smallest is the form.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.common import discard, materialize

#: Classes of letters.
PARTS = 4
#: Fixed value: the letters of a run.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(df: DataFrame, id_col: str, text: str, least: int = 1) -> DataFrame:
    """(id, run): the maximal runs of letters, of `least` code points or more, with A-Z in lower case; one row for each place."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    return df.select(F.col(id_col).alias("id"), F.explode(found).alias("run")).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))


def misspelt(of: Column, run: Column, every: int = 31) -> Column:
    """The run without one code point, for about one of `every` (document, run) pairs, which its crc32 chooses; else the run."""
    h = F.crc32(F.concat(F.coalesce(of.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def _signatures(word: Column, same: bool, longer: bool = False) -> list[Column]:
    """Signatures of a word that meet those of words of its own length, or of words one letter longer or shorter."""
    parts = [F.get("parts", F.lit(i)) for i in range(PARTS)]
    size = F.length(word) - F.lit(int(longer))  # that of the shorter word
    half = F.floor(size / 2).cast("int")
    kept = list(combinations(range(PARTS), PARTS - (2 if same else 1)))
    halves = (F.substr(word, F.lit(1), half), F.substr(word, F.length(word) - (size - half) + 1))
    return [F.xxhash64(F.lit(same), F.lit(side), F.lit(c), size, text, *(parts[i] for i in which)) for side, text in enumerate(halves) for c, which in enumerate(kept)]


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of words (word, n), distinct, which differ by exactly one code point inserted, deleted or replaced; a pair may come more than once."""
    letters = F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))
    held = lambda i: F.array_sort(F.filter("letters", lambda x: F.pmod(F.ascii(x), F.lit(PARTS)) == i))
    classes = F.array(*(F.array_join(held(i), "") for i in range(PARTS)))
    rows = materialize(words.withColumn("letters", letters).select("word", "n", classes.alias("parts")), "letters")
    word = F.col("word")

    def side(x: str, *more: Column) -> DataFrame:
        signed = F.explode(F.array(*_signatures(word, True), *more)).alias("sig")
        return rows.select(signed, F.col("word").alias(x), F.col("n").alias(f"{x}_n"))

    met = side("a", *_signatures(word, False, longer=True)).join(side("b", *_signatures(word, False)), "sig")
    more = F.length("a") - F.length("b")
    met = met.where(((more == 0) & (F.col("a") < F.col("b"))) | (more == 1))
    return met.where(F.levenshtein("a", "b", 1) == 1).drop("sig")


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), distinct.

    A word's form is its most frequent near word (ties: the smallest), if that is `ratio` times as
    frequent or more; its root is where forms lead. Each form is at least `ratio` times as frequent as
    what it is the form of, so with a ratio of 2 or more no chain has over 63 links.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = materialize(words.where("word IS NOT NULL"), "words")
    pairs = near_pairs(words)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b_n").alias("n"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a_n").alias("n"), F.col("a").alias("other"))))
    near = pairs.select(both.alias("p")).groupBy("p.word").agg(F.collect_set(F.struct((-F.col("p.n")).alias("n"), F.col("p.other").alias("other"))).alias("near"))
    near = near.select("word", F.size("near").cast("long").alias("n_near"), F.array_min("near").alias("best"))
    best = F.col("best.other").isNotNull() & (-F.col("best.n") >= ratio * F.col("n"))
    told = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(best, F.col("best.other")).alias("form"), F.when(best, -F.col("best.n")).alias("form_n")
    )
    told = materialize(told, "forms")
    roots = _roots(told.where("form IS NOT NULL").select("word", F.col("form").alias("to")))
    out = told.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, to): where links (word, to), which have no circle, end; each round doubles the way."""
    now = materialize(links, "links")
    while True:
        over = now.select(F.col("word").alias("to"), F.col("to").alias("_to"))
        ahead = materialize(now.join(over, "to", "left").select("word", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("_on")), "links")
        discard(now)
        if ahead.where("_on").isEmpty():
            return ahead.drop("_on")
        now = ahead.drop("_on")
        now._table = ahead._table
