"""Support, lift and concentration of terms; catalogues and coverage.

Distinct posts per account are counted first and then rolled up, so no aggregate expands its rows, and
effective accounts come from the same pass. Medians are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.functions import scalars as S
from reelgraph.runtime import materialize

#: Rows of a key from which its medians are found over bins.
HOT = 1_000_000


def baseline(posts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Median metric of described posts with views, by keys; that of worlds in two passes (see wide_median)."""
    rows = posts.where("described").select(*keys, S.metric(F.col("views")).alias("_m"))
    if keys == ["world"]:
        return wide_median(rows, keys, "_m", name)
    return rows.groupBy(*keys).agg(F.median("_m").alias(name)).where(F.col(name).isNotNull())


def wide_median(rows: DataFrame, keys: list[str], value: str, name: str, bins: int = 1000, levels: int = 1) -> DataFrame:
    """(keys.., name): exact medians of few groups of any size.

    The built-in median holds all distinct values of a group in one task. Here values are counted in
    bins (`bins` a unit), which is summed in the tasks; the one or two bins in the middle are cut into
    bins again, `bins` to each, if `levels` is over 1; only the values of the last are counted themselves.
    Groups without a value have no row; keys are not null.
    """
    rows = rows.where(F.col(value).isNotNull()).withColumns({"_before": F.lit(0).cast("long"), "_total": F.lit(0).cast("long")})
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)  # ranks from 0
    holds = lambda rank: (F.col("_end") > rank) & (F.col("_end") - F.col("_k") <= rank)
    for level in range(1, levels + 1):
        rows = rows.withColumn("_bin", F.floor(F.col(value) * float(bins) ** level))
        within = Window.partitionBy(*keys, "_before")  # rows of one bin of the level above
        counts = rows.groupBy(*keys, "_before", "_total", "_bin").agg(F.count(F.lit(1)).alias("_k"))
        if level == 1:
            counts = counts.withColumn("_total", F.sum("_k").over(within))
        counts = counts.withColumn("_end", F.col("_before") + F.sum("_k").over(within.orderBy("_bin")))
        middle = counts.where(holds(low) | holds(high)).select(*keys, F.col("_before").alias("_at"), "_bin", "_total", (F.col("_end") - F.col("_k")).alias("_before"))
        rows = rows.drop("_total").withColumnRenamed("_before", "_at").join(middle, [*keys, "_at", "_bin"]).drop("_at")
    values = rows.groupBy(*keys, "_total", "_before", value).agg(F.count(F.lit(1)).alias("_k"))
    values = values.withColumn("_end", F.col("_before") + F.sum("_k").over(Window.partitionBy(*keys, "_before").orderBy(value)))
    pick = lambda rank: F.min(F.when(F.col("_end") > rank, F.col(value)))
    return values.groupBy(*keys).agg(((pick(low) + pick(high)) / 2).alias(name))


def with_medians(rows: DataFrame, keys: list[str], medians: dict[str, Column], others: list[Column], hot: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """rows.groupBy(keys).agg(medians.., others..) with exact medians, however many rows one key has.

    Keys of more than `hot` rows (HOT) are found by a count, or told by counts (keys.., _rows); their
    rows are written and theirs come from wide_median(). There is at most one such key for each `hot`
    rows, so they are broadcast. All others have the built-in median, which then holds at most `hot`
    values of a key. Keys may be null.
    """
    hot = HOT if hot is None else hot
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")) if counts is None else counts
    many = counts.where(F.col("_rows") > hot).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    plain = [*(F.median(c).alias(n) for n, c in medians.items()), *others]
    if many.isEmpty():
        return rows.groupBy(*keys).agg(*plain)
    many = F.broadcast(materialize(many, "hot"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    usual = rows.join(many, same, "left_anti").groupBy(*keys).agg(*plain)
    large = rows.join(many, same, "left_semi").withColumns({"_key": F.to_json(F.struct(*keys))} | {f"_v{i}": c for i, c in enumerate(medians.values())})
    large = materialize(large, "hot")
    out = large.groupBy(*keys, "_key").agg(F.count(F.lit(1)).alias("_all"), *others)
    for i, name in enumerate(medians):
        out = out.join(wide_median(large.select("_key", f"_v{i}"), ["_key"], f"_v{i}", name, levels=2), "_key", "left")
    return usual.unionByName(out.select(*usual.columns))


def rankable(edges: DataFrame) -> DataFrame:
    """Edges that count: sure ones with a metric, without products that are merely in frame."""
    product = F.coalesce((F.col("facet") == "product") & (F.col("prominence") == "incidental"), F.lit(False))
    return edges.where(~F.col("low_conf") & F.col("metric").isNotNull() & ~product)


def support(edges: DataFrame, keys: list[str]) -> DataFrame:
    """n_posts, n_accounts and effective_accounts (inverse Herfindahl) of each key."""
    return _counted(edges, keys).drop("_rows")


def _counted(edges: DataFrame, keys: list[str]) -> DataFrame:
    """support(), and the number of rows of each key."""
    each = edges.groupBy(*keys, "account_id", "post_id").agg(F.count(F.lit(1)).alias("_1")).groupBy(*keys, "account_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("_1").alias("_rows"))
    return each.groupBy(*keys).agg(
        F.sum("_n").alias("n_posts"), F.count(F.lit(1)).alias("n_accounts"), (F.pow(F.sum("_n"), 2) / F.sum(F.col("_n") * F.col("_n"))).alias("effective_accounts"), F.sum("_rows").alias("_rows")
    )


def term_stats(edges: DataFrame, posts: DataFrame, min_posts: int = 3, min_accounts: int = 3, min_effective: float = 0.0, count_hero: bool = True) -> DataFrame:
    """Ranked terms by (world, facet, canon_term). edges must be rankable(); metrics are medians over rows."""
    keys = ["world", "facet", "canon_term"]
    edges = materialize(edges.select(*keys, "account_id", "post_id", "metric", "raw_term", *(["prominence"] if count_hero else [])), "ranked")
    known = _counted(edges, keys).where((F.col("n_posts") >= min_posts) & (F.col("n_accounts") >= min_accounts))
    if min_effective:
        known = known.where(F.col("effective_accounts") >= min_effective)
    known = materialize(known, "support")
    rows = edges.join(baseline(posts, ["world", "account_id"], "account_median"), ["world", "account_id"], "left")
    hero = F.count_if(F.col("prominence") == "hero") if count_hero else F.lit(0).cast("long")
    medians = {"median_m": F.col("metric"), "account_lift": F.col("metric") - F.col("account_median")}
    spread = with_medians(rows, keys, medians, [hero.alias("n_hero"), F.sort_array(F.collect_set("raw_term")).alias("variants")], counts=known.select(*keys, "_rows"))
    spread = spread.withColumn("account_lift", F.coalesce("account_lift", F.lit(0.0)))
    out = known.drop("_rows").join(spread, keys).join(baseline(posts, ["world"], "world_median"), "world", "left")
    lift = F.col("median_m") - F.coalesce("world_median", F.lit(0.0))
    return out.withColumn("lift", lift).select(
        *keys, "n_posts", "n_accounts", "effective_accounts", "n_hero", "median_m", "lift", F.exp("lift").alias("view_ratio"), "account_lift", F.exp("account_lift").alias("account_view_ratio"), "variants"
    )


def assert_centred(stats: DataFrame, tolerance: float = 1.0) -> None:
    """The quality gate: ranked terms scatter around the baseline."""
    middle = stats.agg(F.median("lift")).first()[0]
    if middle is not None and abs(middle) >= tolerance:
        raise ValueError(f"median lift {middle} is off the baseline")


def dedupe_stats(stats: DataFrame) -> DataFrame:
    """One row per (world, facet, canon_term): that with most posts, the first of the given `order` on ties (else that with the higher, then the lower values of all columns)."""
    keys = ["world", "facet", "canon_term"]
    rest = [c for c in stats.columns if c not in (*keys, "n_posts", "order")]
    place = [-F.col("order")] if "order" in stats.columns else []
    best = stats.groupBy(*keys).agg(F.max(F.struct("n_posts", *(p.alias("_o") for p in place), *rest)).alias("_s"))
    return best.select(*keys, "_s.n_posts", *(f"_s.{c}" for c in rest)).select(*(c for c in stats.columns if c != "order"))


def catalogue(worlds: DataFrame, posts: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Each world, with or without posts, by name: n_posts, n_accounts, vlm_coverage, and computed_at, the latest of its stats, if these are given."""
    got = posts.groupBy("world").agg(F.count(F.lit(1)).alias("n_posts"), F.countDistinct("account_id").alias("n_accounts"), F.avg(F.col("described").cast("double")).alias("vlm_coverage"))
    out = worlds.select("world").join(got, "world", "left").fillna(0, ["n_posts", "n_accounts"]).fillna(0.0, ["vlm_coverage"])
    if stats is not None:
        out = out.join(stats.groupBy("world").agg(F.max("computed_at").alias("computed_at")), "world", "left")
    return out.orderBy("world")


def world_counts(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts per world, most first; the number of worlds that have any)."""
    counts = posts.where(F.col("world").isNotNull()).groupBy("world").agg(F.count(F.lit(1)).alias("n_posts"))
    return counts.orderBy(F.desc("n_posts"), "world"), counts.agg(F.count(F.lit(1)).alias("n_active"))


def coverage(posts: DataFrame) -> DataFrame:
    """Per world: posts, described, unsure, share of described posts without a product, accounts, median views."""
    return posts.groupBy("world").agg(
        F.count(F.lit(1)).alias("n_posts"), F.count_if("described").alias("n_with_vlm"), F.count_if("low_conf").alias("n_low_conf"),
        F.avg(F.when(F.col("described"), (F.col("n_products") == 0).cast("double"))).alias("no_product_rate"),
        F.countDistinct("account_id").alias("n_accounts"), F.expm1(F.median(F.when(F.col("described"), S.metric(F.col("views"))))).alias("median_views"),
    )


def canonical_labels(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Of each cluster's (norm_term, n) the most frequent term, the smallest on ties."""
    return counts.groupBy(*keys).agg(F.min_by("norm_term", F.struct(-F.col("n"), "norm_term")).alias("canon_term"))


def volume_ratio(stats: DataFrame) -> DataFrame:
    """n_posts against the facet's median before any filter."""
    middle = stats.groupBy("world", "facet").agg(F.median("n_posts").alias("_mid"))
    return stats.join(middle, ["world", "facet"]).withColumn("volume_ratio", F.when(F.col("_mid") != 0, F.col("n_posts") / F.col("_mid")).otherwise(0.0)).drop("_mid")
