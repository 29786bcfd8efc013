"""The routing flow: which posts can be routed, their texts and vectors, the nearest world, and rules on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgraph.functions import scalars as S
from reelgraph.operators import upkeep, vectors
from reelgraph.runtime import materialize
from reelgraph.sources import sinks


def world_vectors(worlds: DataFrame, embedder=vectors.hashed_embedder) -> DataFrame:
    """(slug, centroid) of worlds (slug, description, snippets): the embedded text of both."""
    texts = worlds.select("slug", F.concat_ws("\n", "description", "snippets").alias("text"))
    return texts.join(vectors.embed(texts, None, text="text", embedder=embedder), "text").select("slug", vectors.unit(F.col("vector")).alias("centroid"))


def route_posts(
    posts: DataFrame, worlds: DataFrame, table: DataFrame | None = None, rules: list[tuple[str, Column, str | None]] = (), only_new: bool = False, budget: int = 150,
    embedder=vectors.hashed_embedder,
) -> DataFrame:
    """(post_id, world, cosine, margin) of posts (post_id, visual_description, and what rules speak of) against worlds (slug, centroid).

    Posts without a description are not routed. Equal texts, cut to the budget, are embedded once. The
    targets of rules do not compete; a rule may move a winner of its parent there or hold it out (null
    world, which deletes an earlier route in store()). only_new leaves out posts that the table has.
    """
    rows = posts.where(S.truthy(F.trim("visual_description")))
    rows = upkeep.unrouted(rows, table) if only_new and table is not None else rows
    rows = rows.withColumn("_blob", S.token_budget(F.col("visual_description"), budget))
    known = vectors.embed(rows, None, text="_blob", embedder=embedder)
    rows = materialize(rows.join(known, "_blob").drop("_blob"), "routable")
    targets = [t for p, _, t in rules if t is not None and t != p]
    found = vectors.route(rows, worlds.where(~F.col("slug").isin(*targets)) if targets else worlds, "post_id", "vector")
    if not rules:
        return found
    out = rows.drop("vector").join(found, "post_id")
    return out.withColumn("world", vectors.split_by_rules(F.col("world"), list(rules))).select("post_id", "world", "cosine", "margin")


def store(table: DataFrame, routed: DataFrame) -> DataFrame:
    """The table of routes afterwards: replaced by post, and without posts that are held out."""
    version = lambda df, n: df.select(*table.columns).withColumn("_v", F.lit(n))
    return sinks.upsert(version(table, 0), version(routed, 1), ["post_id"], "_v", drop_null="world").drop("_v")
