"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.lit(0))).first())


def components(edges: DataFrame, scratch: Scratch, name: str, most: int = 60) -> DataFrame:
    """(v, comp): each vertex of ``edges(a, b)`` with the smallest vertex reachable from it.

    Each round keeps every component connected and hooks vertices on smaller
    ones; it ends with stars. The rounds grow with the logarithm of the
    components' sizes. No vertex's neighbours are gathered: minima are
    aggregates, joined back. No edges give no rows. The result is written as ``name``.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    mark, k, width = _mark(now), 0, partitions(edges.sparkSession)
    while mark[0]:
        # One exchange serves a vertex's minimum and the join with it.
        both = now.union(now.select("b", "a")).repartition(width, "a")
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.where("m < a").select("a", F.col("m").alias("b")))
        large = large.repartition(width, "a")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        k += 1
        after = scratch.keep(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now, old, mark = after, mark, _mark(after)
        if mark == old:
            break
        if k == most:
            raise RuntimeError("components didn't settle")
    out = scratch.keep(now.select(F.col("a").alias("v"), F.col("b").alias("comp")).union(now.select("b", "b").distinct()), name)
    scratch.drop(f"{name}-{k}")
    return out
