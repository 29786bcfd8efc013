"""Account patterns: what an account's peak posts have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.functions import scalars as S
from reelgraph.operators import pages, passes, rank, vectors
from reelgraph.runtime import materialize


def in_scope(posts: DataFrame, routed: DataFrame, world: str) -> DataFrame:
    """All posts, of whatever world, of accounts that have a post routed to one."""
    return posts.join(routed.where(F.col("world") == world).select("account_id").distinct(), "account_id", "left_semi")


def clustered_peaks(posts: DataFrame, embedded: DataFrame, threshold: float = 0.70, least: int = 10) -> DataFrame:
    """Peaks of all accounts (see rank.peaks) with cluster, its smallest post id, and cluster_size; peaks without a vector have neither.

    posts has account_id, post_id and views; embedded (post_id, vector).
    """
    found = materialize(rank.peaks(posts, least=least)[0], "peaks")
    rows = found.select("account_id", F.col("post_id").alias("id")).join(embedded.select(F.col("post_id").alias("id"), "vector"), "id")
    # written before the filter, which would else be taken to all posts' vectors
    rows = materialize(rows.select("account_id", "id", vectors.unit(F.col("vector")).alias("v")), "embedded").where("v IS NOT NULL")
    parts = vectors.threshold_components(rows, ["account_id"], threshold).select("account_id", F.col("id").alias("post_id"), F.col("component").alias("cluster"))
    sizes = parts.groupBy("account_id", "cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    return found.join(parts.join(sizes, ["account_id", "cluster"]), ["account_id", "post_id"], "left")


def patterns(posts: DataFrame, products: DataFrame, embedded: DataFrame, notes: DataFrame, threshold: float = 0.70, least: int = 10) -> DataFrame:
    """One row per pattern (two or more peaks of an account that hang together): account_id, key (its smallest post id), size, names, topics, about, members, annotation, n_peaks.

    posts (post_id, account_id, views, format, setting, summary); products (post_id, name, brand,
    topic). members are post ids, most viewed first (ties: smaller id); the first one's summary ends `about`.
    """
    found = materialize(clustered_peaks(posts, embedded, threshold, least), "peaks")
    counted = found.groupBy("account_id").agg(F.count(F.lit(1)).alias("n_peaks"))
    keys = ["account_id", "cluster"]
    members = found.where("cluster_size >= 2")
    by_views = F.struct((-F.coalesce("views", F.lit(0))).alias("o"), "post_id", "summary")
    each = members.groupBy(*keys).agg(F.array_sort(F.collect_list(by_views)).alias("_m"), F.count(F.lit(1)).alias("size"))
    labels = passes.pattern_labels(members, products, keys).join(passes.modal_value(members, keys, "setting"), keys, "left")
    rows = each.join(labels, keys)
    topics = F.transform("topics", lambda t: t["topic"])
    rows = rows.select(
        *keys, "size", F.coalesce("names", F.array().cast("array<string>")).alias("names"), "topics", F.transform("_m", lambda m: m["post_id"]).alias("members"),
        S.about(F.col("modal_format"), F.col("modal_setting"), topics, F.col("_m")[0]["summary"]).alias("about"),
    )
    return pages.annotated(rows, notes, F.col("cluster").cast("string")).drop("cluster").join(counted, "account_id")


def account_list(found: DataFrame) -> DataFrame:
    """Accounts with their patterns in order: favourites, then by sort_order, size and key; accounts that have a favourite first, then by their largest pattern in sight."""
    order = F.struct((~F.col("favorite")).alias("f"), F.col("sort_order").alias("s"), (-F.col("size")).alias("z"), F.col("key").alias("k"))
    one = F.struct(order.alias("o"), "key", "size", "about", "names", "topics", "members", "note", "favorite", "reviewed", "hidden", "sort_order")
    out = found.groupBy("account_id").agg(
        F.max("n_peaks").alias("n_peaks"), F.array_sort(F.collect_list(one)).alias("_p"), F.bool_or("favorite").alias("any_favorite"),
        F.coalesce(F.max(F.when(~F.col("hidden"), F.col("size"))), F.lit(0)).alias("largest"),
    )
    out = out.withColumn("patterns", F.transform("_p", lambda p: p.dropFields("o"))).drop("_p")
    return out.orderBy(F.desc("any_favorite"), F.desc("largest"), "account_id")


def resolve_account(accounts: DataFrame, handle: str, platform: str = "tiktok"):
    """The id of the one account of that handle; none or several are an error."""
    found = [r["account_id"] for r in accounts.where((F.col("handle") == handle) & (F.col("platform") == platform)).select("account_id").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'several accounts are' if found else 'no account is'} called {handle} on {platform}")
    return found[0]


def peak_report(posts: DataFrame, products: DataFrame, embedded: DataFrame, accounts: DataFrame, threshold: float = 0.70, least: int = 10) -> DataFrame:
    """A row per peak, also of those in no cluster: cluster_id (text; `unclustered` without a vector), cluster_size, names and topics of the cluster, url, metric and z to four places.

    posts (post_id, account_id, external_id, views, format, posted_at); in order of account, cluster_id and views. One account's report is a filter on account_id.
    """
    found = materialize(clustered_peaks(posts, embedded, threshold, least), "peaks")
    labels = passes.pattern_labels(found.where("cluster IS NOT NULL"), products, ["account_id", "cluster"])
    shown = F.transform("topics", lambda t: F.concat(t["topic"], F.lit(" ("), t["n"].cast("string"), F.lit(")")))
    rows = found.join(labels, ["account_id", "cluster"], "left").join(accounts.select("account_id", "handle"), "account_id")
    return rows.select(
        "account_id", "post_id", F.coalesce(F.col("cluster").cast("string"), F.lit("unclustered")).alias("cluster_id"), F.coalesce("cluster_size", F.lit(1)).alias("cluster_size"),
        F.coalesce(F.array_join("names", " | "), F.lit("")).alias("cluster_products"), F.coalesce(F.array_join(shown, " | "), F.lit("")).alias("cluster_top_topics"),
        S.video_url(F.col("handle"), F.col("external_id")).alias("video_url"), S.iso(F.col("posted_at")).alias("posted_at"), "views",
        F.round("metric", 4).alias("metric_log1p_views"), F.round("modified_z", 4).alias("modified_z"),
    ).orderBy("account_id", "cluster_id", F.desc("views"), "post_id")


def peak_summary(posts: DataFrame, products: DataFrame, embedded: DataFrame, least: int = 10) -> DataFrame:
    """What heads the peak report, a row per account: how its peaks were found (see rank.peaks), how many show no named product and how many have a vector; no_product_rate is null without peaks.

    posts has account_id, post_id and views; products (post_id, name); embedded (post_id, ..).
    """
    found, info = rank.peaks(posts, least=least)
    named = products.where(S.truthy(F.col("name"))).select("post_id").distinct().withColumn("_named", F.lit(True))
    vectors_ = embedded.select("post_id").distinct().withColumn("_vector", F.lit(True))
    rows = found.select("account_id", "post_id").join(named, "post_id", "left").join(vectors_, "post_id", "left")
    counts = rows.groupBy("account_id").agg(F.count_if(F.col("_named").isNull()).alias("n_no_product"), F.count_if(F.col("_vector").isNotNull()).alias("n_embedded"))
    out = info.join(counts, "account_id", "left").fillna(0, ["n_no_product", "n_embedded"])
    return out.withColumn("no_product_rate", F.when(F.col("n_peaks") > 0, F.col("n_no_product") / F.col("n_peaks")))
