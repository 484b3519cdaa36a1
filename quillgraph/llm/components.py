"""Connected components of links by alternating stars; nothing gathers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import dropped, saved


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u").toDF("u", "v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", "m").toDF("u", "v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (u, v) to (u, v): each node but the least of its component, with that least node.

    Any type with an order will do. Every round writes its stars to the shared folder.
    """
    e = saved(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    known = None
    while True:
        before, e = e, saved(_small_star(_large_star(e)), "stars")
        dropped(before)
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == known or not mark[0]:
            return e
        known = mark
