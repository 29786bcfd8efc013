"""Scalar functions over columns: names, texts, keys, times. All native expressions."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
ARTICLES = ["a", "an", "the"]
FILLER = ["not_applicable", "unclear"]
#: Least and greatest number of posts of a band (None: open), and the account floors on offer.
SIZE_BANDS = {"6+": (6, None), "3-5": (3, 5), "6-9": (6, 9), "10-24": (10, 24), "25+": (25, None)}
ACCOUNT_FLOORS = [3, 4, 5, 6]
VIDEO_URL = "https://www.tiktok.com/@%s/video/%s"


def truthy(c: Column) -> Column:
    """Non-null and non-empty string."""
    return c.isNotNull() & (c != "")


def metric(views: Column) -> Column:
    """log1p(views); null and zero views have none."""
    return F.when(views != 0, F.log1p(views.cast("double")))


def singularize(word: Column) -> Column:
    cut = lambda n: word.substr(F.lit(1), F.length(word) - n)
    sibilant = word.endswith("ses") | word.endswith("xes") | word.endswith("zes") | word.endswith("ches") | word.endswith("shes")
    return (
        F.when(word.endswith("ies") & (F.length(word) > 3), F.concat(cut(3), F.lit("y")))
        .when(sibilant, cut(2)).when(word.endswith("s") & ~word.endswith("ss"), cut(1)).otherwise(word)
    )


def normalize(text: Column) -> Column:
    """Lower case, hyphens to spaces, punctuation out (Unicode), articles out, last word singular.

    The words are bound as the one element of a list, and so split once a row, not at each mention.
    """
    plain = F.regexp_replace(F.translate(F.lower(text), "-", " "), r"(?U)[^\w\s]", "")
    words = F.filter(F.split(plain, r"(?U)\s+"), lambda w: (w != "") & ~w.isin(*ARTICLES))

    def joined(words: Column) -> Column:
        last = F.transform(F.slice(words, -1, 1), singularize)  # one word
        return F.when(F.size(words) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.slice(words, 1, F.size(words) - 1), last), " "))

    return F.when(text.isNotNull(), F.get(F.transform(F.array(words), joined), F.lit(0)))


def query_text(text: Column) -> Column:
    """Search-query form: lower case, only a-z, 0-9 and spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""))


def epoch(seconds: Column) -> Column:
    """Epoch seconds to a timestamp; what cannot be read is null."""
    return F.timestamp_seconds(seconds.try_cast("bigint"))


def strip_nul(raw: Column) -> Column:
    """A JSON document without NUL characters, escaped or not."""
    return F.regexp_replace(raw, r"\\u0000|\x00", "")


def prose(summary: Column, setting: Column, topics: Column, products: Column) -> Column:
    """The text that routing embeds: summary, setting, topics and products, one line each; empty parts are left out."""
    named = F.transform(F.filter(products, lambda p: truthy(p["name"])), lambda p: F.when(truthy(p["brand"]), F.concat(p["brand"], F.lit(" "), p["name"])).otherwise(p["name"]))
    return F.concat_ws(
        "\n",
        F.when(truthy(summary), F.trim(summary)),
        F.when(truthy(setting), F.concat(F.lit("Setting: "), setting, F.lit("."))),
        F.when(F.size(topics) > 0, F.concat(F.lit("Topics: "), F.array_join(topics, ", "), F.lit("."))),
        F.when(F.size(named) > 0, F.concat(F.lit("Products: "), F.array_join(named, ", "), F.lit("."))),
    )


def token_budget(text: Column, most: int = 150) -> Column:
    """Trimmed and cut to a number of whitespace tokens."""
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, most), " ")


def premise_text(premise: Column, summary: Column, topics: Column, stage: Column) -> Column:
    """The premise; else summary and topics, unless the stage says that none applies."""
    fallback = F.concat_ws(" ", F.when(truthy(F.trim(summary)), F.trim(summary)), F.when(F.size(topics) > 0, F.array_join(topics, " ")))
    return F.when(truthy(F.trim(premise)), F.trim(premise)).when(stage.eqNullSafe(F.lit("not_applicable")), F.lit(None)).otherwise(F.nullif(fallback, F.lit("")))


def about(format_: Column, setting: Column, topics: Column, summary: Column) -> Column:
    """`format · setting — those of the first three topics that are neither — summary`, empty parts left out."""
    more = F.filter(F.slice(topics, 1, 3), lambda t: ~t.eqNullSafe(format_) & ~t.eqNullSafe(setting))
    head = F.concat_ws(" · ", F.when(truthy(format_), format_), F.when(truthy(setting), setting))
    line = F.concat_ws(" — ", F.nullif(head, F.lit("")), F.when(F.size(more) > 0, F.array_join(more, ", ")), F.when(truthy(F.trim(summary)), F.trim(summary)))
    return F.coalesce(line, F.lit(""))


def term_key(slug: Column, facet: Column, canon: Column) -> Column:
    return F.concat_ws(":", slug, facet, canon)


def joined_notes(notes: Column) -> Column:
    return F.array_join(F.filter(F.transform(notes, lambda n: F.trim(n)), lambda n: n != ""), " · ")


def fingerprint(ids: Column) -> Column:
    """16 hex characters that name a set of ids (an aggregate)."""
    return F.substring(F.sha2(F.array_join(F.sort_array(F.collect_set(ids.cast("string"))), ","), 256), 1, 16)


def size_band(n: Column) -> Column:
    """The narrow band that a number of posts falls into; null below all."""
    return F.when(n >= 25, "25+").when(n >= 10, "10-24").when(n >= 6, "6-9").when(n >= 3, "3-5")


def in_band(n: Column, band: str) -> Column:
    """Whether a number of posts lies in a band of SIZE_BANDS."""
    least, most = SIZE_BANDS[band]
    return n >= least if most is None else n.between(least, most)


def video_url(handle: Column, external_id: Column) -> Column:
    return F.format_string(VIDEO_URL, handle, external_id)


def iso(at: Column) -> Column:
    """ISO 8601 in UTC, whatever the session's time zone."""
    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def cut(text: Column, most: int) -> Column:
    """The first characters of a text."""
    return F.substring(text, 1, most)


def days_before(as_of: str, days: int) -> Column:
    """The instant `days` before a date or time in UTC, whatever the session's time zone."""
    at = datetime.fromisoformat(as_of)
    at = (at if at.tzinfo else at.replace(tzinfo=timezone.utc)) - timedelta(days=days)
    return F.timestamp_seconds(F.lit(at.timestamp()))


def product_names(products: Column) -> Column:
    """`brand name` of each product that has a name, in order and as written."""
    named = F.filter(products, lambda p: truthy(p["name"]))
    return F.transform(named, lambda p: F.when(truthy(p["brand"]), F.concat(p["brand"], F.lit(" "), p["name"])).otherwise(p["name"]))


def clean_topics(topics: Column) -> Column:
    """Topics without blanks, trimmed."""
    return F.filter(F.transform(topics, lambda t: F.trim(t)), truthy)


def advice_text(present: Column, content: Column) -> Column:
    """The advice, of texts that give any."""
    return F.when(F.coalesce(present, F.lit(False)), F.nullif(F.trim(content), F.lit("")))


def terminal(vlm: Column, attempts: Column, most: int = 3) -> Column:
    """Whether work on a post is over: it is described, or was tried `most` times."""
    return vlm.isNotNull() | (F.coalesce(attempts, F.lit(0)) >= most)


def stratum(field: str, value: str | float, op: str | None = None) -> Column:
    """Equality on a dotted path, or `lt` / `ge` against a number."""
    col = F.col(field)
    return col.cast("string") == str(value) if op is None else {"lt": col < value, "ge": col >= value}[op]


def document(text: Column) -> Column:
    """A JSON text as a VARIANT, beside whatever columns a schema declares of it; null where it is no JSON."""
    return F.try_parse_json(text)


def stratum_in(doc: Column, path: str, value: str | float | bool, op: str | None = None) -> Column:
    """stratum() on a dotted path of a VARIANT that no schema need declare; a number stands for a place in a list.

    A path that is missing, or whose value cannot be read as a text (with an op: as a number), is in no
    stratum (null).
    """
    if '"' in path or "\\" in path:
        raise ValueError("a path of names without quotes or backslashes")
    at = "$" + "".join(f"[{x}]" if x.isdigit() else f'["{x}"]' for x in path.split("."))
    if op is None:
        return F.try_variant_get(doc, at, "string") == (str(value).lower() if isinstance(value, bool) else str(value))
    number = F.try_variant_get(doc, at, "double")
    return {"lt": number < value, "ge": number >= value}[op]


def duration_bucket(seconds: Column) -> Column:
    return F.when(seconds < 8, "<8").when(seconds < 15, "8-15").when(seconds < 30, "15-30").when(seconds.isNotNull(), "30+")
