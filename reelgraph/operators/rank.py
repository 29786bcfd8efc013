"""Peaks, routing ranks, budgets, pages and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelgraph.functions import scalars as S
from reelgraph.operators.stats import with_medians
from reelgraph.runtime import materialize


def peaks(posts: DataFrame, by: str = "account_id", least: int = 10, z: float = 3.5, share: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """(peaks with metric and modified_z, one row of info per account).

    Modified z where an account has `least` posts with views and a spread; else the top share by metric
    (ties: smaller post id), without a z. Two aggregates joined back; only the fallback ranks rows.
    """
    rows = posts.withColumn("metric", S.metric(F.col("views"))).where("metric IS NOT NULL")
    counts = materialize(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_rows")), "counts")
    mid = with_medians(rows, [by], {"med": F.col("metric")}, [F.count(F.lit(1)).alias("n_total")], counts=counts)
    rows = rows.join(mid, by)
    spread = with_medians(rows, [by], {"mad": F.abs(F.col("metric") - F.col("med"))}, [], counts=counts)
    rows = rows.join(spread, by)
    use_z = (F.col("n_total") >= least) & (F.col("mad") != 0)
    score = F.when(use_z, F.lit(0.6745) * (F.col("metric") - F.col("med")) / F.col("mad"))
    by_z = rows.where(use_z).withColumn("modified_z", score).where(F.col("modified_z") >= z)
    top = rows.where(~use_z).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("metric"), "post_id")))
    top = top.where(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n_total")))).drop("_r").withColumn("modified_z", F.lit(None).cast("double"))
    found = by_z.unionByName(top)
    info = mid.join(spread, by).join(found.groupBy(by).agg(F.count(F.lit(1)).alias("n_peaks"), F.min("metric").alias("_low")), by, "left")
    cutoff = F.when(use_z, F.lit(z) * F.col("mad") / F.lit(0.6745) + F.col("med")).otherwise(F.col("_low"))
    info = info.select(
        by, F.when(use_z, "modified_z_score").otherwise("top_10_percent").alias("method"), F.floor(F.round(F.expm1(cutoff), 6)).alias("cutoff_views"), "n_total", F.coalesce("n_peaks", F.lit(0)).alias("n_peaks")
    )
    return found.drop("med", "mad", "n_total"), info


def cooccurrence(edges: DataFrame, top: int = 5) -> DataFrame:
    """The terms that share most posts with each term: (world, facet, term, other, shared_posts, share, rn).

    Edges are read once, to a row per post with its terms. Pairs are made of it and counted in one order, and turned after that.
    """
    known = edges.where("world IS NOT NULL AND facet IS NOT NULL AND post_id IS NOT NULL AND canon_term IS NOT NULL")
    sets = materialize(known.groupBy("world", "facet", "post_id").agg(F.array_sort(F.collect_set("canon_term")).alias("terms")), "sets")
    first = sets.select("world", "facet", F.posexplode("terms").alias("i", "canon_term"), "terms")
    pairs = first.select("world", "facet", "canon_term", F.explode(F.slice("terms", F.col("i") + 2, F.size("terms"))).alias("other"))
    once = pairs.groupBy("world", "facet", "canon_term", "other").agg(F.count(F.lit(1)).alias("shared_posts"))
    ends = F.explode(F.array(F.struct(F.col("canon_term").alias("term"), "other"), F.struct(F.col("other").alias("term"), F.col("canon_term").alias("other"))))
    shared = once.select("world", "facet", ends.alias("_e"), "shared_posts").select("world", "facet", "_e.term", "_e.other", "shared_posts")
    rank = F.row_number().over(Window.partitionBy("world", "facet", "term").orderBy(F.desc("shared_posts"), "other"))
    best = shared.withColumn("rn", rank).where(F.col("rn") <= top)
    sizes = sets.select("world", "facet", F.explode("terms").alias("term")).groupBy("world", "facet", "term").agg(F.count(F.lit(1)).alias("n"))
    return best.join(sizes, ["world", "facet", "term"]).withColumn("share", F.round(F.col("shared_posts") / F.col("n"), 3)).drop("n")


def merge_candidates(edges: DataFrame, stats: DataFrame, min_posts: int = 6, min_accounts: int = 4, top: int = 5) -> DataFrame:
    """Ranked terms put up for decision: their norm_terms, variants and the terms that share most posts with them, each sorted."""
    keys = ["world", "facet", "canon_term"]
    rows = stats.where((F.col("n_posts") >= min_posts) & (F.col("n_accounts") >= min_accounts)).select(*keys, "n_posts", "n_accounts", "variants")
    norms = edges.groupBy(*keys).agg(F.array_sort(F.collect_set("norm_term")).alias("norm_terms"))
    near = cooccurrence(edges, top).groupBy("world", "facet", F.col("term").alias("canon_term"))
    near = near.agg(F.array_sort(F.collect_list(F.struct("rn", F.col("other").alias("term"), "shared_posts", "share"))).alias("co_occurring"))
    return rows.join(norms, keys).join(near, keys, "left")


def budget_prefix(rows: DataFrame, by: list[str], order: str, size: str, limit: int, most: int = 10_000) -> DataFrame:
    """Per group the longest prefix (by order) whose sizes sum to the limit at most; one row at least, `most` rows at most."""
    rows = positions(rows, by, order, size)
    return rows.where((F.col("rn") == 1) | ((F.col("cum") <= limit) & (F.col("rn") <= most)))


def positions(rows: DataFrame, by: list[str], order: str, size: str | None = None) -> DataFrame:
    """rows with rn, the place in their group by order, and with size cum, its running sum.

    Rows are cut into ranges of group and order; a range is numbered on its own, and what stands
    before it in its group comes from one count per range, so a large group is not sorted in one task.
    """
    ranged = rows.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    total = F.sum(size) if size else F.lit(0)
    counts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.coalesce(total, F.lit(0)).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_sum")))
    group = Window.partitionBy(*by, "_range").orderBy(order)
    out = ranged.withColumn("rn", F.row_number().over(group))
    if size:
        out = out.withColumn("cum", F.sum(size).over(group.rowsBetween(Window.unboundedPreceding, 0)))
    renamed = counts.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), F.col("_range").alias("_r"), "_n", "_sum")
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    out = out.join(renamed, same).withColumn("rn", F.col("rn") + F.col("_n"))
    out = out.withColumn("cum", F.col("cum") + F.col("_sum")) if size else out
    return out.select(*rows.columns, "rn", *(["cum"] if size else []))


def top_terms(stats: DataFrame, n: int = 25, fewer: dict[str, int] | None = None) -> DataFrame:
    """The n terms of each world and facet with most lift (ties: smaller term), with their rank rn; fewer names facets with another n."""
    limit = F.lit(n)
    for facet, k in (fewer or {}).items():
        limit = F.when(F.col("facet") == facet, k).otherwise(limit)
    by = Window.partitionBy("world", "facet").orderBy(F.round("lift", 9).desc(), "canon_term")
    return stats.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= limit)


def pending_queries(ledger: DataFrame, world: str, n: int = 5) -> DataFrame:
    """The next n pending queries of a world, by round, then id."""
    return ledger.where((F.col("world_slug") == world) & (F.col("status") == "pending")).orderBy("round_no", "id").limit(n)


def first_handles(handles: DataFrame, n: int = 20) -> DataFrame:
    """Of each query's handles (query, handle, pos) the first n."""
    by = Window.partitionBy("query").orderBy("pos", "handle")
    return handles.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).drop("_n")


def systematic_sample(rows: DataFrame, by: str, order: str, most: int = 4000) -> DataFrame:
    """Every k-th row of each group, k = ceil(n / most)."""
    sizes = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).alias("_k"))
    return positions(rows, [by], order).join(sizes, by).where((F.col("rn") - 1) % F.col("_k") == 0).select(*rows.columns)


def pending(rows: DataFrame, value: str, attempts: str, order: str, limit: int, most: int = 3) -> DataFrame:
    """Work to claim: no value yet, fewer than `most` attempts, in order."""
    return rows.where(F.col(value).isNull() & (F.coalesce(attempts, F.lit(0)) < most)).orderBy(order).limit(limit)


def top_values(rows: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each group (ties: smaller value)."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))).where(F.col("rn") <= k)
