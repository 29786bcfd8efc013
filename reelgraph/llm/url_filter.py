"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

A URL's host is what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased;
its path runs on from there to `?`, `#` or the end. Each distinct (host, path) is expanded to all its
host suffixes (at label bounds) and to path prefixes whose lengths are powers of two (and the empty
one); a rule is filed under the longest such prefix of its own path. The expressions meet the rules
on the first 32 bits of their SHA-256; then the full digests of host suffix and of the path at the
rule's own length must agree, and the longest rule wins (ties: the longer host, then block before
allow, then the smaller action). So a rule's path may have any length, and an URL has few expressions.
The whole path is native: no Python runs on the executors.

Cases: a null URL or one without `://` has empty host and path, and fits only a rule for the empty
host (there is none by default). Repeated rows are judged each; a URL without a rule is allowed. A
rule with a null host, path or action is left out; repeated rules count once. Very long URLs are
judged whole. Empty tables give empty results. Other columns are kept, whatever their names, and one
that is named like an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "rule_host string, rule_path string, action string"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, action) as a table."""
    return spark.createDataFrame(rules, RULE_SCHEMA)


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path), never null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _digest(host: F.Column, path: F.Column) -> F.Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _filed(length: F.Column) -> F.Column:
    """The greatest power of two that is not above a length (0: none)."""
    return F.when(length > 0, F.call_function("shiftleft", F.lit(1), F.length(F.bin(length)) - 1)).otherwise(0)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (host and path of the rule that won, else null) and verdict."""
    rules = rules.where("rule_host IS NOT NULL AND rule_path IS NOT NULL AND action IS NOT NULL").select("rule_host", "rule_path", "action").distinct()
    start = F.substring("rule_path", F.lit(1), _filed(F.length("rule_path")))
    wanted = rules.withColumns({"rule_digest": _digest(F.col("rule_host"), F.col("rule_path")), "short": F.substring(_digest(F.col("rule_host"), start), 1, 8)})
    host, path = split_url(F.col(url))
    # the caller's columns stand in a struct, so no name of theirs meets one of ours
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    lengths = F.concat(F.array(F.lit(0)), F.when(F.length("path") > 0, F.transform(F.sequence(F.lit(0), F.length(F.bin(F.length("path"))) - 1), lambda k: F.call_function("shiftleft", F.lit(1), k))).otherwise(F.array().cast("array<int>")))
    expressions = (
        rows.select("host", "path").distinct()
        .withColumn("suffix", F.explode(suffixes)).withColumn("start", F.explode(F.transform(lengths, lambda n: F.substring("path", F.lit(1), n))))
        .withColumn("short", F.substring(_digest(F.col("suffix"), F.col("start")), 1, 8))
    )
    order = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("a"), F.length("rule_host").alias("b"), (F.col("action") == "block").alias("c"),
        "rule_host", "rule_path", "action",
    )
    fits = F.col("rule_digest") == _digest(F.col("suffix"), F.substring("path", F.lit(1), F.length("rule_path")))
    best = expressions.join(wanted, "short").where(fits).groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.max(order).alias("won"))
    own = ["host", "path", "rule", "verdict"]
    return rows.join(best, (F.col("host") == F.col("r_host")) & (F.col("path") == F.col("r_path")), "left").select(
        *(F.col("row").getField(c).alias(c) for c in pages.columns if c.lower() not in own),
        "host", "path",
        F.concat("won.rule_host", "won.rule_path").alias("rule"),
        F.coalesce("won.action", F.lit(default)).alias("verdict"),
    )
