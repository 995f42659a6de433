"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (u > v).  Minima are combined before the shuffle; the join may split a hot centre's rows."""
    if large:
        around = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = links.select("u", "v")
    least = around.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("__v"))
    least = least.withColumn("m", F.least("__u", "__v"))
    joined = around.join(least, F.col("u") == F.col("__u"))
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("__u").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` (the least node reachable) for every node of ``links`` (columns ``u``, ``v``, longs).

    Each round is a written table, so lineage stays short and lost executors cost one round at most.  The result is a
    written table.  Links of a node with itself are ignored; no links give an empty result.
    """
    spark = links.sparkSession
    now = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        new = written(_star(_star(now, True), False), "links")
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(spark, now)
        now = new
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
