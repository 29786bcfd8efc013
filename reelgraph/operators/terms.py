"""Nested descriptions to (post, facet, term) edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgraph.functions import scalars as S
from reelgraph.runtime import materialize

#: How a facet's terms are made canonical.
CLUSTERED = ["product", "format", "format_trait", "topic", "setting", "characters_dynamic"]
NORMALIZED = ["brand", "music_author"]
_TERM = "array<struct<facet:string,raw_term:string,prominence:string>>"


def _terms(facet: str, values: Column, prominence: Column | None = None) -> Column:
    """Terms of one facet from an array of strings (or of structs with name and prominence)."""
    if prominence is not None:
        rows = F.transform(values, lambda p: F.struct(F.lit(facet).alias("facet"), p["name"].alias("raw_term"), p["prominence"].alias("prominence")))
    else:
        rows = F.transform(values, lambda x: F.struct(F.lit(facet).alias("facet"), x.alias("raw_term"), F.lit(None).cast("string").alias("prominence")))
    return F.filter(F.coalesce(rows, F.array().cast(_TERM)), lambda t: S.truthy(t["raw_term"]))


def real(value: Column) -> Column:
    """An enum value that says something: null for filler and for the empty string."""
    return F.when(S.truthy(value) & ~value.isin(*S.FILLER), value)


def cell(a: Column, b: Column) -> Column:
    """A cross-tab cell, null unless both sides say something."""
    return F.when(real(a).isNotNull() & real(b).isNotNull(), F.concat(a, F.lit(" x "), b))


def extract_terms(posts: DataFrame, vlm: str = "vlm", raw: str | None = "vlm_raw", keep: list[str] | None = None, dedupe: bool = True) -> DataFrame:
    """keep columns with facet, raw_term, prominence and low_conf: one row per post, facet and raw term, the first kept.

    posts has the document as struct `vlm` and, where key-absent must be told from null, as JSON text
    `raw`; music_original and music_author come from the scrape and give terms without a document too.
    A post is one row.
    """
    v = lambda path: F.col(f"{vlm}.{path}")
    one = lambda facet, value: _terms(facet, F.array(value))
    enums = [(f"relationship_{k}", v(f"relationship.{k}")) for k in ("stage", "conflict", "register", "resolution", "perspective")]
    enums += [("characters_pairing", v("characters.pairing")), ("synthetic_presenter", v("synthetic.presenter")), ("synthetic_voice", v("synthetic.voice"))]
    enums += [(f"pacing_{k}", v(f"pacing.{k}")) for k in ("energy_arc", "humor_sincerity", "speaker_dominance", "density")]
    parts = [
        _terms("product", v("products"), F.lit(True)), _terms("brand", F.transform(v("products"), lambda p: p["brand"])), _terms("brand", v("entities.brands")),
        one("format", v("format")), _terms("format_trait", v("format_traits")), _terms("topic", v("topics")), one("setting", v("setting")),
        one("cta", v("cta")), one("audio_kind", v("audio.kind")), *(one(f, real(c)) for f, c in enums),
        one("conflict_x_register", cell(v("relationship.conflict"), v("relationship.register"))),
        one("register_x_resolution", cell(v("relationship.register"), v("relationship.resolution"))),
        one("register_x_advice_specificity", cell(v("relationship.register"), v("advice.specificity"))),
        one("characters_dynamic", v("characters.dynamic")),
    ]
    if raw:
        asked = F.array_contains(F.json_object_keys(F.col(raw)), "punchline")
        parts.append(one("punchline_presence", F.when(asked, F.when(S.truthy(v("punchline")), "has_punchline").otherwise("no_punchline"))))
    spoken = F.concat(*parts)
    spoken = F.when(F.col(vlm).isNotNull(), spoken).otherwise(F.array().cast(_TERM))
    scraped = F.concat(
        one("audio_source", F.when(F.col("music_original"), "original_audio").when(~F.col("music_original"), "licensed_audio")),
        one("music_author", F.when(~F.col("music_original"), F.col("music_author"))),
    )
    low = F.coalesce(v("confidence") == "low", F.lit(False))
    keep = keep or ["post_id"]
    marked = lambda found, low: F.transform(found, lambda t: F.struct(t["facet"].alias("facet"), t["raw_term"].alias("raw_term"), t["prominence"].alias("prominence"), low.alias("low_conf")))
    rows = posts.select(*keep, F.concat(marked(spoken, low), marked(scraped, F.lit(False))).alias("_all"))
    if dedupe:  # within the post's own list, before it is opened, so nothing is shuffled; the keys are bound as the one element of a list
        keys = F.transform("_all", lambda t: F.concat(t["facet"], F.lit("\n"), t["raw_term"]))
        first = F.transform(F.array(keys), lambda k: F.filter("_all", lambda t, i: F.array_position(k, F.get(k, i)) == i + 1))
        rows = rows.select(*keep, F.get(first, F.lit(0)).alias("_all"))
    rows = rows.select(*keep, F.posexplode("_all").alias("ord", "t")).select(*keep, "t.facet", "t.raw_term", "t.prominence", "ord", "t.low_conf")
    return rows.drop("ord") if dedupe else rows


def first_terms(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first (by ord) of rows that share keys, facet and raw_term."""
    rest = [c for c in rows.columns if c not in (*keys, "facet", "raw_term", "ord")]
    first = rows.groupBy(*keys, "facet", "raw_term").agg(F.min_by(F.struct(*rest), "ord").alias("_f"))
    return first.select(*keys, "facet", "raw_term", *(f"_f.{c}" for c in rest))


def with_norm(edges: DataFrame) -> DataFrame:
    """norm_term, and canon_term as it is before clustering: raw facets stay as they are."""
    norm = F.when(F.col("facet").isin(*CLUSTERED, *NORMALIZED), S.normalize(F.col("raw_term"))).otherwise(F.col("raw_term"))
    return edges.withColumn("norm_term", norm).withColumn("canon_term", F.col("norm_term"))


def with_norm_once(edges: DataFrame) -> DataFrame:
    """with_norm() of stored edges, which are read twice: a raw term is normalised once, however many edges have it."""
    named = F.col("facet").isin(*CLUSTERED, *NORMALIZED)
    known = materialize(edges.where(named).select("raw_term").distinct().withColumn("_norm", S.normalize(F.col("raw_term"))), "norms")
    rows = edges.join(known, "raw_term", "left").withColumn("norm_term", F.when(named, F.col("_norm")).otherwise(F.col("raw_term")))
    return rows.select(*edges.columns, "norm_term", F.col("norm_term").alias("canon_term"))
