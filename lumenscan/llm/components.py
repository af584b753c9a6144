"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Each step sends the neighbours of a node to its least neighbour; the minimum is taken by partial aggregation and joined
back. Nodes of more than ``hot`` neighbours, which are at most edges / hot many, are joined by broadcast, so the edges of a
star's centre stay spread over the tasks that hold them. Steps end in tables in the shared folder; the one before is
deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm._common import clean, dropped, joined_hot, mark, paths_of, written

HOT = 1_000_000


def _star(edges: DataFrame, large: bool, hot: int) -> DataFrame:
    """edges (a > b) -> edges after one step."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("many"))
    if large:
        least = least.withColumn("least", F.least("a", "least"))
    joined = joined_hot(both, least, ["a"], "many", hot)
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame, hot: int = HOT) -> DataFrame:
    """links (a, b: long) -> (node, root) of every node of a link; root is the least node of its component. A table of the shared folder."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    state, spark = None, links.sparkSession
    while True:
        since = mark()
        before, edges = edges, written(_star(_star(edges, True, hot), False, hot), "edges")
        clean(spark, since, keep=paths_of(edges))
        dropped(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    out = written(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "components")
    dropped(edges)
    return out
