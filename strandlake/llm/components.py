"""Connected components of a graph of long ids, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import drop_written, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) to (id, root): every id of an edge with the smallest id that it reaches.

    Each step writes its edges to the shared folder and only their count and checksum reach the driver. A star of any
    size stays a set of rows: no neighbour list is ever gathered.
    """
    now = written(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        sum_ = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not sum_["n"] or (sum_["n"], sum_["s"]) == before:
            break
        before = (sum_["n"], sum_["s"])
        after = written(_small_star(_large_star(now)), "edges")
        drop_written(now)
        now = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
