"""Quality rules: a table of thresholds, compiled into native column expressions.

A row of the table is (measure, least, most); a text is kept if each measure lies within its bounds
(None: open). Measures are ratios of lengths, symbols, stop words and lines. No user function runs.

Cases: a null or empty text has no words and fails the base rule; a measure over zero words is zero;
a measure equal to its bound is within it; repeated rows are judged each; very long texts are measured
whole, in arrays as long as their words; an empty table gives an empty one; other columns are kept,
whatever their names, and one named like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is for by with on was as at be this "
    "der die das und in den von zu mit sich ist auf ein eine nicht "
    "le la les de des du et un une que qui dans pour par sur au en "
    "el los las y se con una no del"
).split()
#: (measure, least, most).
THRESHOLDS = [
    ("mean_word_chars", 1.5, 20.0),
    ("symbols_per_word", None, 0.5),
    ("stop_word_share", 0.01, None),
    ("dup_line_share", None, 0.5),
    ("letter_share", 0.5, None),
]
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word_chars", "symbols_per_word", "stop_word_share", "dup_line_share", "letter_share"]


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios, from one narrow chain of projections.

    Windows of three words are sorted by their hash, so equal ones are neighbours, and words are
    compared only where hashes agree.
    """
    pre = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0))  # a prefix that no column has
    whole, words, lines, ordered, starts = (f"{pre}{x}" for x in ("whole", "words", "lines", "ordered", "starts"))
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {*COLUMNS, *RATIOS}]
    df = df.select(*keep, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(whole))
    df = df.withColumns({
        words: F.filter(F.split(whole, SPACE_CLASS + "+"), lambda x: x != ""),
        lines: F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
    })
    n = F.size(words)
    window = lambda i: (F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    made = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(*window(i)).alias("h"), i.alias("i")))
    made = F.sort_array(F.when(n >= 3, made).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    df = df.withColumns({ordered: made, "n_words": n.cast("long")})

    def like(x, at):
        y = F.get(ordered, at)
        same = y.getField("h") == x.getField("h")
        for v, w in zip(window(x.getField("i")), window(y.getField("i")), strict=True):
            same = same & (v == w)
        return F.coalesce(same, F.lit(False))

    again = F.filter(ordered, lambda x, i: like(x, i - 1) | like(x, i + 1))
    df = df.withColumn(starts, F.transform(again, lambda x: x.getField("i")))
    covered = F.size(F.array_distinct(F.concat(starts, F.transform(starts, lambda i: i + 1), F.transform(starts, lambda i: i + 2))))
    some = F.greatest(F.col("n_words"), F.lit(1))
    stops = F.size(F.filter(words, lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS))))
    rest = F.col(whole)
    for symbol in SYMBOLS:
        rest = F.replace(rest, F.lit(symbol), F.lit(""))
    letters = F.length(F.regexp_replace(whole, r"\P{L}+", ""))
    df = df.withColumns({
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(rest)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    })
    df = df.withColumns({
        "mean_word_chars": F.col("word_chars") / some,
        "symbols_per_word": F.col("n_symbols") / some,
        "stop_word_share": stops / some,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.size(lines), F.lit(1)),
        "letter_share": letters / F.greatest(F.col("word_chars"), F.lit(1)),
    })
    return df.drop(whole, words, lines, ordered, starts)


def verdict(thresholds: list[tuple] = THRESHOLDS) -> F.Column:
    """The table as one boolean expression over the measures."""
    held = F.lit(True)
    for measure, least, most in thresholds:
        if least is not None:
            held = held & (F.col(measure) >= F.lit(float(least)))
        if most is not None:
            held = held & (F.col(measure) <= F.lit(float(most)))
    return held


def judge(df: DataFrame, text: str = "text", min_words: int = 50, max_repeat_percent: int = 50, thresholds: list[tuple] = THRESHOLDS) -> DataFrame:
    """df with the measures, base_failed and kept."""
    out = measures(df, text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(thresholds))
