"""Landed feed payloads, catalogues and listings as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgraph.functions import scalars as S
from reelgraph.sources.schema import FEED, VLM

UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def payloads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(payloads with code 0 and their file, rejected ones)."""
    rows = spark.read.schema(FEED).json(path).withColumn("file", F.col("_metadata.file_name"))
    return rows.where("code = 0"), rows.where("code IS NULL OR code <> 0")


def accounts(feed: DataFrame, platform: str = "tiktok") -> DataFrame:
    """One account per payload with videos, from its first video's author; the follower count is unknown."""
    author = F.get("data.videos", F.lit(0))["author"]
    return feed.where(F.size("data.videos") > 0).select(
        F.lit(platform).alias("platform"), author["id"].alias("external_id"), author["unique_id"].alias("handle"), F.lit(None).cast("int").alias("follower_count")
    )


def posts(feed: DataFrame) -> DataFrame:
    """One row per video; missing counters are 0."""
    first = F.get("data.videos", F.lit(0))["author"]["id"]
    v = feed.select(first.alias("account_external_id"), F.explode("data.videos").alias("v"))
    return v.select(
        "account_external_id", F.col("v.video_id").alias("external_id"), F.col("v.title").alias("caption"),
        F.struct("v.play", "v.wmplay", "v.cover").alias("media_urls"), S.epoch(F.col("v.create_time")).alias("posted_at"),
        *(F.coalesce(F.col(f"v.{a}"), F.lit(0)).alias(b) for a, b in (("digg_count", "likes"), ("share_count", "shares"), ("play_count", "views"))),
        F.coalesce("v.origin_cover", "v.cover").alias("thumbnail_url"),
        *(F.col(f"v.music_info.{c}").alias(f"music_{c}") for c in ("id", "title", "author", "original")),
    )


def comments(feed: DataFrame) -> DataFrame:
    """struct<total, comments> per payload."""
    one = lambda c: F.struct(c["id"].alias("id"), c["text"].alias("text"), F.coalesce(c["digg_count"], F.lit(0)).alias("likes"), F.coalesce(c["reply_total"], F.lit(0)).alias("reply_count"), S.epoch(c["create_time"]).alias("posted_at"), c["user"]["unique_id"].alias("author"))
    return feed.select("file", F.struct(F.coalesce("data.total", F.lit(0)).alias("total"), F.transform("data.comments", one).alias("comments")).alias("comments"))


def search_results(feed: DataFrame) -> DataFrame:
    """(query, page, handles, cursor, has_more) of search payloads that carry query and page: authors in order, and where to go on."""
    handles = F.transform("data.videos", lambda v: v["author"]["unique_id"])
    more = F.coalesce("data.hasMore", F.lit(False))
    return feed.select("query", "page", F.coalesce(handles, F.array().cast("array<string>")).alias("handles"), F.coalesce("data.cursor", F.lit("0")).alias("cursor"), more.alias("has_more"))


def search_pages(pages: DataFrame, most: int = 3) -> DataFrame:
    """Pages (query, page, handles, has_more) that a walk reads: it ends after `most`, or with the first page without handles or more."""
    stop = (F.size("handles") <= 0) | ~F.coalesce("has_more", F.lit(False))
    before = F.coalesce(F.max(stop).over(Window.partitionBy("query").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return pages.where(F.col("page") <= most).withColumn("ended", before).where(~F.col("ended")).drop("ended")


def search_handles(pages: DataFrame) -> DataFrame:
    """(query, handle, pos): distinct handles, first seen first; missing ones are skipped."""
    rows = pages.select("query", "page", F.posexplode("handles").alias("i", "handle")).where(S.truthy(F.col("handle")))
    return rows.groupBy("query", "handle").agg(F.min(F.struct("page", "i")).alias("pos"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of lines that are neither blank nor comments."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")


def world_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(slug, description) of text files, one a world, named by it: lines that are not comments, in order, trimmed at both ends."""
    rows = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: ~F.startswith(F.ltrim(x), F.lit("#")))
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("slug"), F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "").alias("description"))


def seed_queries(lines: DataFrame, ledger: DataFrame, world: str) -> DataFrame:
    """Seed rows of a world, none if its ledger has a row of round 0."""
    had = ledger.where((F.col("world_slug") == world) & (F.col("round_no") == 0)).select("world_slug", "round_no").distinct()
    rows = lines.select(F.lit(world).alias("world_slug"), F.lit(0).alias("round_no"), F.col("line").alias("query_text"), F.lit("seed").alias("intent"), F.lit("pending").alias("status"))
    return rows.join(had, ["world_slug", "round_no"], "left_anti")


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Description files, one document each; the id is the file's name."""
    rows = spark.read.option("multiLine", True).schema(VLM).json(path)
    return rows.withColumn("post_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))


def overrides(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("world string, facet string, term string, action string, target string").option("header", True).csv(path)
    return rows.withColumn("target", F.nullif("target", F.lit("")))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    schema = "world string, facet string, canon_term string, n_posts bigint, n_accounts bigint, norm_terms array<string>, variants array<string>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def candidate_scope(candidates: DataFrame) -> tuple[str, str] | None:
    """(world, facet) of the first of the candidates, which are all of one."""
    first = candidates.select("world", "facet").first()
    return (first["world"], first["facet"]) if first else None


def distinct_of(rows: DataFrame, column: str) -> DataFrame:
    """Distinct handles, worlds or accounts; missing ones are left out."""
    return rows.where(F.col(column).isNotNull()).select(column).distinct()


def listed_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of files in a folder whose name is a UUID; contents are not read."""
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return spark.read.format("binaryFile").load(path).select(name.alias("post_id")).where(F.col("post_id").rlike(UUID)).distinct()


def described(responses: DataFrame, registered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(post_id, vlm, vlm_raw) of responses (post_id, file_name, error, raw) that name a registered (post_id, file_name) and hold a document; and the rest."""
    raw = S.strip_nul(F.col("raw"))
    rows = responses.join(registered.select("post_id", "file_name").distinct().withColumn("_known", F.lit(True)), ["post_id", "file_name"], "left")
    rows = rows.withColumns({"vlm_raw": raw, "vlm": F.when(F.json_object_keys(raw).isNotNull(), F.from_json(raw, VLM))})
    good = F.col("_known").isNotNull() & F.col("error").isNull() & F.col("vlm").isNotNull()
    return rows.where(good).select("post_id", "vlm", "vlm_raw"), rows.where(~good).select(*responses.columns)
