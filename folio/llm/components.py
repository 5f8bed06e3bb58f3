"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _towards_least(near: DataFrame, keep, name: str) -> DataFrame:
    """near's rows with `m`, the least of u and its neighbours.  The minima are written before the join, so both of its
    sides have an exchange of their own and Spark can split the rows of a node that a third of all others link to."""
    least = common.durable(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), name)
    return near.join(least, "u").where(keep)


def stars(links: DataFrame, name: str = "links") -> DataFrame:
    """links(u, v) of any direction -> (u, v): each node that has a link, with the least node of its component (u != v).

    Each step is two shuffles of the links and is written to the shared folder, so a lost executor costs one step.
    The number of steps grows with the logarithm of a component's size.
    """
    now = common.durable(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = _mark(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both, F.col("v") > F.col("u"), name).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.durable(large, name)
        met = _towards_least(large, F.lit(True), name)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = common.durable(small, name)
        if (after := _mark(now)) == mark:
            return now
        mark = after
