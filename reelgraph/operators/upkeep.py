"""Keeping the corpus whole: what needs work, what a re-listed feed still has, health counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.functions import scalars as S


def id_sets(wanted: DataFrame, present: DataFrame, key: str = "post_id") -> DataFrame:
    """(key, side): `missing` if wanted but not present, `both`, or `extra`. Count by side for the sizes."""
    w = wanted.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_w", F.lit(True))
    p = present.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_p", F.lit(True))
    side = F.when(F.col("_p").isNull(), "missing").when(F.col("_w").isNull(), "extra").otherwise("both")
    return w.join(p, key, "full_outer").select(key, side.alias("side"))


def redescribe_scope(posts: DataFrame, available: DataFrame) -> DataFrame:
    """One row per world of posts (post_id, world, handle, described): n_need, n_have of them with a landed file, n_fetch without, n_accounts to fetch from."""
    need = posts.where(~F.col("described")).join(available.select("post_id").distinct().withColumn("_has", F.lit(True)), "post_id", "left")
    has = F.coalesce("_has", F.lit(False))
    return need.groupBy("world").agg(
        F.count(F.lit(1)).alias("n_need"), F.count_if(has).alias("n_have"), F.count_if(~has).alias("n_fetch"), F.count_distinct(F.when(~has, F.col("handle"))).alias("n_accounts"),
    )


def relisted(missing: DataFrame, feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts that the account's feed lists again, with what it now says; posts that it no longer lists).

    missing (account_external_id, external_id, post_id), feed as feeds.posts() gives it.
    """
    key = ["account_external_id", "external_id"]
    fresh = feed.dropDuplicates(key)
    return missing.join(fresh, key), missing.join(fresh.select(*key), key, "left_anti")


def unrouted(posts: DataFrame, routed: DataFrame) -> DataFrame:
    """Posts that no route has seen."""
    return posts.join(routed.select("post_id"), "post_id", "left_anti")


def next_round(ledger: DataFrame) -> DataFrame:
    """(world_slug, round_no): the round after the last of each world."""
    return ledger.groupBy("world_slug").agg((F.max("round_no") + 1).alias("round_no"))


def crawl_health(posts: DataFrame, top: int = 40) -> tuple[DataFrame, DataFrame]:
    """(per discovering world: posts, accounts, described ones; per world its `top` commonest raw topics).

    posts (world, account_id, described, topics).
    """
    from reelgraph.operators.rank import top_values

    health = posts.groupBy("world").agg(F.count(F.lit(1)).alias("n_posts"), F.count_distinct("account_id").alias("n_accounts"), F.count_if("described").alias("n_described"))
    topics = posts.select("world", F.explode(S.clean_topics(F.col("topics"))).alias("topic"))
    return health, top_values(topics, ["world"], "topic", top)
