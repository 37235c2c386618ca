"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Narrow rows with one key that a task takes; keys with more are dealt over several.
HOT_ROWS = 1_000_000


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, spread: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join to a lookup that has one narrow row per key but may be too large to broadcast.

    Only keys with more than ``hot_rows`` rows are spread, by the hash of another column over as many tasks as they
    need, and only their lookup rows are repeated. The counts are aggregated before they are shuffled. There are
    at most rows / hot_rows hot keys, which bounds the list that is broadcast.
    """
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter((F.col("_rows") > hot_rows) & F.col(key).isNotNull())
    hot = F.broadcast(counted.select(key, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    repeated = lookup.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(repeated, [key, "_salt"], "left").drop("_salt")
