"""What is shown: ranked overviews with annotations and children, posts of a term, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgraph.functions import scalars as S
from reelgraph.operators import overrides, stats as support
from reelgraph.sources import sinks

#: Category, whether only worlds of the dialogue schema show it, and its facets in order.
CATEGORIES = [
    ("core", False, ["product", "format", "topic"]),
    ("discounts", False, ["discount_product", "discount_format", "discount_format_trait"]),
    ("niches", False, ["summary_cluster"]),
    ("signals", True, ["relationship_conflict", "relationship_stage", "characters_dynamic", "pacing_energy_arc"]),
    ("crosstabs", True, ["conflict_x_register", "register_x_resolution", "register_x_advice_specificity", "punchline_presence"]),
    ("situations", True, ["premise_cluster", "setting_cluster"]),
    ("advice", True, ["advice_cluster"]),
    ("hooks", True, ["hook_cluster", "punchline_cluster"]),
]
DIALOGUE_WORLDS = ["romance", "ai-romance-subworld"]
SORTS = {"lift": "lift", "volume": "n_posts", "account": "account_lift", "variants": "size(variants)"}
NOTE = {"note": "", "favorite": False, "reviewed": False, "hidden": False, "sort_order": 0}


def annotated(rows: DataFrame, notes: DataFrame, key) -> DataFrame:
    """rows with the annotation under a computed key: note, favorite, reviewed, hidden and sort_order; defaults where there is none. notes has a row per key."""
    known = notes.select(F.col("key").alias("_key"), *(F.col(c).alias(f"_{c}") for c in NOTE if c in notes.columns))
    rows = rows.withColumn("key", key).join(known, F.col("key") == F.col("_key"), "left")
    given = {c: F.coalesce(f"_{c}", F.lit(v)) if c in notes.columns else F.lit(v) for c, v in NOTE.items()}
    return rows.withColumns(given).drop("_key", *(f"_{c}" for c in NOTE if c in notes.columns))


def overview(
    ranked: DataFrame, notes: DataFrame, sort: str = "lift", min_posts: int = 3, max_posts: int | None = None, min_accounts: int = 3, limit: int = 25, offset: int = 0,
    favorites_only: bool = False, show_hidden: bool = True, with_children: bool = False,
) -> DataFrame:
    """A page of each (world, facet) of ranked terms: its rows with volume_ratio, annotation, children, position n and the `total` of rows to page through.

    Favourites come first, then by sort_order, by the chosen key and by term. Floors hold for children
    too; max_posts does not. The facet's median behind volume_ratio is taken before any filter. A
    facet's terms, a catalogue, are ordered in one task.
    """
    if "parent_term" not in ranked.columns:
        ranked = ranked.withColumn("parent_term", F.lit(None).cast("string"))
    rows = support.volume_ratio(ranked).where((F.col("n_posts") >= min_posts) & (F.col("n_accounts") >= min_accounts))
    top = rows if max_posts is None else rows.where((F.col("n_posts") <= max_posts) | F.col("parent_term").isNotNull())
    top = annotated(overrides.nest(top, rows), notes, S.term_key(F.col("world"), F.col("facet"), F.col("canon_term")))
    if favorites_only:
        top = top.where("favorite")
    if not show_hidden:
        top = top.where("NOT hidden")
    if with_children:
        top = top.where(F.size("children") > 0)
    facet = Window.partitionBy("world", "facet")
    order = facet.orderBy(F.desc("favorite"), "sort_order", F.round(F.expr(SORTS[sort]).cast("double"), 9).desc(), "canon_term")
    top = top.withColumns({"n": F.row_number().over(order).cast("long"), "total": F.count(F.lit(1)).over(facet)})
    return top.where((F.col("n") > offset) & (F.col("n") <= offset + limit))


def term_posts(edges: DataFrame, posts: DataFrame, accounts: DataFrame, limit: int = 100) -> DataFrame:
    """The posts of each (world, facet, canon_term), most viewed first, at most `limit`: handle, video_url, views and the smallest raw term that put the post there.

    edges (world, facet, canon_term, post_id, raw_term), posts (post_id, account_id, views, ..), accounts (account_id, handle).
    """
    keys = ["world", "facet", "canon_term"]
    rows = edges.groupBy(*keys, "post_id").agg(F.min("raw_term").alias("matched_term")).join(posts, "post_id").join(accounts.select("account_id", "handle"), "account_id")
    by = Window.partitionBy(*keys).orderBy(F.coalesce("views", F.lit(0)).desc(), "post_id")
    rows = rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= limit)  # not cast before: so tasks keep `limit` of a term before rows move
    return rows.withColumn("n", F.col("n").cast("long")).withColumn("video_url", S.video_url(F.col("handle"), F.col("post_id").cast("string")))


def reorder(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Annotations after the keys were put in this order by hand; other fields and keys stay."""
    spark = notes.sparkSession
    listed = spark.createDataFrame([(keys,)], "k array<string>").select(F.posexplode("k").alias("sort_order", "key"))
    fields = {c: v for c, v in NOTE.items() if c in notes.columns}
    patch = listed.withColumn("at", F.lit(0))
    kinds = dict(notes.dtypes)
    for c in fields:
        if c != "sort_order":
            patch = patch.withColumn(c, F.lit(None).cast(kinds[c]))
    return sinks.merge_patches(notes, patch, "key", "at", fields)


def panels(spark: SparkSession) -> DataFrame:
    """(category, place, dialogue_only, facet) of the panels."""
    rows = [(name, i, only, facet) for name, only, facets in CATEGORIES for i, facet in enumerate(facets)]
    return spark.createDataFrame(rows, "category string, place int, dialogue_only boolean, facet string")


def with_panels(ranked: DataFrame, dialogue_worlds: list[str] = DIALOGUE_WORLDS) -> DataFrame:
    """Ranked terms of facets that a panel shows, with its category and place; panels of the dialogue layer only for worlds that have it."""
    rows = ranked.join(F.broadcast(panels(ranked.sparkSession)), "facet")  # some twenty rows
    return rows.where(~F.col("dialogue_only") | F.col("world").isin(*dialogue_worlds)).drop("dialogue_only")
