"""Write semantics as DataFrames: what the table holds afterwards."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append: the first of each key (by order) that the table lacks."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(table.select(*keys), keys, "left_anti")


def store_feed(accounts: DataFrame, posts: DataFrame, new_accounts: DataFrame, new_posts: DataFrame, world: str, query_id: str) -> tuple[DataFrame, DataFrame]:
    """(accounts, posts) to append to the tables after a crawl: those not there yet, posts with the id of their account and what discovered them.

    accounts (account_id, platform, external_id, ..), posts (account_id, external_id, ..); new_posts has
    account_external_id. An account's id is a digest of its key, so a repeated run makes the same.
    """
    key = ["platform", "external_id"]
    made = new_accounts.withColumn("account_id", F.substring(F.sha2(F.concat_ws(":", *key), 256), 1, 32))
    added = insert_ignore(accounts, made, key, ["account_id"])
    known = accounts.select("account_id", "platform", "external_id").unionByName(added.select("account_id", "platform", "external_id"))
    rows = new_posts.join(known.select("account_id", F.col("external_id").alias("account_external_id")), "account_external_id").drop("account_external_id")
    rows = rows.withColumns({"discovered_by_world": F.lit(world), "discovered_by_query": F.lit(query_id)})
    return added, insert_ignore(posts, rows, ["account_id", "external_id"], ["external_id"])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: str, drop_null: str | None = None) -> DataFrame:
    """The table after rows replaced those of equal keys, the latest version winning; a null in drop_null deletes the key."""
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), version).alias("_r")).select("_r.*")
    out = table.join(latest.select(*keys), keys, "left_anti").unionByName(latest)
    return out.where(F.col(drop_null).isNotNull()) if drop_null else out


def replace_for(table: DataFrame, rows: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """The table with everything in scope replaced by rows."""
    return table.join(scope.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def write_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that rows fall into, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def merge_patches(table: DataFrame, patches: DataFrame, key: str, at: str, fields: dict) -> DataFrame:
    """Annotations after patches: a field that no patch gives stays; fields maps names to defaults."""
    last = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.col(at))).alias(f"_{f}")
    new = patches.groupBy(key).agg(*map(last, fields))
    default = lambda v: F.lit(v)
    return table.join(new, key, "full_outer").select(key, *(F.coalesce(f"_{f}", f, default(v)).alias(f) for f, v in fields.items()))


def write_csv(rows: DataFrame, folder: str, prefix: str, at: datetime) -> str:
    """Write CSV with a header under a name that holds the time; returns its path."""
    path = f"{folder}/{prefix}_{at:%Y%m%d_%H%M%S}"
    rows.write.option("header", True).csv(path)
    return path


def write_candidates(rows: DataFrame, path: str) -> None:
    """Candidates as JSON, those with most posts first."""
    rows.orderBy(F.desc("n_posts"), "canon_term").write.json(path)


def backup_and_reset(rows: DataFrame, in_scope, path: str, columns: list[str], counters: list[str]) -> DataFrame:
    """reset(), after the rows in scope are written as JSON lines; without rows nothing is lost that was not backed up."""
    rows.where(in_scope).write.json(path)
    return reset(rows, in_scope, columns, counters)


def reset(rows: DataFrame, in_scope, columns: list[str], counters: list[str]) -> DataFrame:
    """Rows in scope with columns emptied and counters at zero."""
    out = rows.withColumns({c: F.when(~in_scope, F.col(c)) for c in columns})
    return out.withColumns({c: F.when(in_scope, F.lit(0)).otherwise(F.col(c)) for c in counters})


def ledger_yield(queries: DataFrame, found: DataFrame, known: DataFrame, executed_at: datetime | None = None) -> DataFrame:
    """queries (query_id) with handles_found and new_handles of found (query_id, handle), and executed_at if given; queries without any count 0."""
    flagged = found.distinct().join(known.select("handle").distinct().withColumn("_known", F.lit(True)), "handle", "left")
    got = flagged.groupBy("query_id").agg(F.count(F.lit(1)).alias("handles_found"), F.count_if(F.col("_known").isNull()).alias("new_handles"))
    out = queries.join(got, "query_id", "left").fillna(0, ["handles_found", "new_handles"]).withColumn("status", F.lit("done"))
    return out if executed_at is None else out.withColumn("executed_at", F.lit(executed_at))
