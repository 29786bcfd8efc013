"""A joint map of worlds and posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.operators import vectors
from reelgraph.operators.axes import reduce_dimensions

AXES = ["x", "y", "z"]


def positions(posts: DataFrame, worlds: DataFrame, post_id: str, vector: str) -> DataFrame:
    """(kind, id, world, similarity, x, y, z) of worlds (slug, centroid) and routed posts on three joint principal axes.

    posts has post_id, world, cosine and a vector. Fewer than five vectors give no rows; vectors of
    fewer than three dimensions have 0 on the missing axes; posts without a vector are left out.
    """
    w = worlds.select(F.lit("world").alias("kind"), F.col("slug").cast("string").alias("id"), F.col("slug").cast("string").alias("world"), F.lit(None).cast("double").alias("similarity"), vectors.unit(F.col("centroid")).alias("v"))
    p = posts.select(F.lit("post").alias("kind"), F.col(post_id).cast("string").alias("id"), F.col("world").cast("string").alias("world"), F.col("cosine").alias("similarity"), vectors.unit(F.col(vector)).alias("v"))
    both = w.unionByName(p).where("v IS NOT NULL")
    if both.limit(5).count() < 5:
        both = both.where(F.lit(False))
    else:
        both = reduce_dimensions(both, [], "v", 3, rotate=True)
    return both.select("kind", "id", "world", "similarity", *(F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)).alias(a) for i, a in enumerate(AXES)))


def layout(points: DataFrame, radius: float = 1.0, least_pull: float = 0.32, more_pull: float = 0.55) -> DataFrame:
    """points centred and scaled by the widest axis; posts are pulled to their world by their similarity, taken against all posts.

    A similarity that is missing counts as 0.8; a post whose world has no point stays where it is.
    """
    ends = [f(a).alias(f"_{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    like = F.coalesce("similarity", F.lit(0.8))
    seen = F.when(F.col("kind") == "post", like)
    span = points.agg(*ends, F.min(seen).alias("_least"), F.max(seen).alias("_most"))  # one row
    half = F.greatest(*((F.col(f"_hi{a}") - F.col(f"_lo{a}")) / 2 for a in AXES))
    rows = points.join(F.broadcast(span)).withColumn("_half", F.when(half > 0, half).otherwise(1.0))
    rows = rows.withColumns({a: (F.col(a) - (F.col(f"_lo{a}") + F.col(f"_hi{a}")) / 2) * radius / F.col("_half") for a in AXES})
    anchors = rows.where("kind = 'world'").select("world", *(F.col(a).alias(f"_a{a}") for a in AXES))
    rows = rows.join(anchors, "world", "left")
    wide = F.col("_most") - F.col("_least")
    pull = least_pull + more_pull * (like - F.col("_least")) / F.when(wide > 0, wide).otherwise(1.0)
    moved = lambda a: F.when((F.col("kind") == "post") & F.col(f"_a{a}").isNotNull(), F.col(a) + (F.col(f"_a{a}") - F.col(a)) * pull).otherwise(F.col(a)).alias(a)
    return rows.select("kind", "id", "world", "similarity", *map(moved, AXES))
