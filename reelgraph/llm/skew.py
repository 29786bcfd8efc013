"""Joining rows back to the counts of their keys, however many rows one key has.

A key with more than 1 / SHARE of all counted rows is split: its rows are dealt over as many parts as
its share asks for, and its count is repeated once for each. There are at most SHARE such keys, since
their counts add up to the total, so they may be broadcast, and at most 2 * SHARE repeated counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No part of a key holds more than about 1 / SHARE of the counted rows.
SHARE = 1000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str = "n", share: int | None = None, how: str = "inner") -> DataFrame:
    """rows joined to counted (keys.., n, ..) on keys, which are not null; n is dropped. Rows without a count go (how left: stay).

    counted should stand in a table, since it is read three times. A row's part comes from a hash of the
    row, so a recomputed task deals as the first one did. Equal rows of a split key share a part.
    """
    share = share or SHARE
    total = counted.agg(F.sum(n)).first()[0] or 1
    parts = F.greatest(F.lit(1), F.ceil(F.col(n) * share / F.lit(total))).cast("int")
    hot = counted.where(F.col(n) * share > total).select(*keys, parts.alias("_parts"))
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int")).otherwise(0)
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", part).drop("_parts")
    copies = counted.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(n)
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")
