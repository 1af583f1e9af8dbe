"""Connected components of an edge table, by alternating large and small stars; every step is a shuffle of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import settle, spread_join


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """node, label: label is the smallest node that node is connected to. Nodes without an edge to another are not listed.

    edges: u, v (bigint, not null). An empty table gives no rows; repeated edges and edges of a node to itself change nothing. A star's
    centre may have most of the edges: its joins are spread over tasks. Stars make at most one edge of each edge, so the table never grows; the number of
    rounds grows with the logarithm of the longest path.
    """
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both.where("v > u"), least, "u", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        now = settle(small.where("u <> v").distinct())
        after = _mark(now)
        if after == before:
            break
        before = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
