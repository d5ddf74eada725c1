"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return _distinct(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return _distinct(down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, owner: str) -> DataFrame:
    """(u, v): each node u that isn't the smallest of its component, and that smallest node v.

    Every step writes its edges to the shared folder; the steps needed grow with the logarithm
    of the longest path.
    """
    before = common.written(owner)
    now = common.materialize(_distinct(edges.select("u", "v")), owner)
    seen = None
    while True:
        now = common.materialize(_small_star(_large_star(now)), owner)
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            common.drop(owner, edges.sparkSession, since=before, keep=1)
            common.release(edges.sparkSession)
            return now
        seen = sign
