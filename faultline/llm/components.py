"""Connected components by alternating large and small stars, as joins over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.tables import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of every node on its least one."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("node"), F.least("a", "least").alias("least")
    )
    hung = both.join(least, F.col("a") == F.col("node"))
    if large:
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of `edges` (a, b); a component is named by its least node.

    Rounds grow with the logarithm of the longest path. Each is written, which cuts lineage; only a
    count and a checksum come back.
    """
    edges = written(edges.where("a <> b").distinct(), "edges")
    mark = None
    while True:
        edges = written(_star(_star(edges, True), False), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
