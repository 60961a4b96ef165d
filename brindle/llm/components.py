"""Connected components of a distributed edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import discard, written_at


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (columns a and b, long) but the roots, with the smallest node it can reach.

    Edges stay a table; every round is two joins and aggregations on it. What a round leaves is written, so lineage
    stays short, and the tables of the round before are deleted. Only a node with a smaller neighbour is a join key that
    matches, and both sides of that join come from tables, so adaptive execution can split a node with very many edges.
    Rounds end as soon as every edge points at a node without a smaller neighbour and no node has two edges.
    """
    spark = edges.sparkSession
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges, path = written_at(edges, "edges")
    while True:
        lower, lower_path = written_at(edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "at"), "lower")
        pointed, pointed_path = written_at(edges.join(lower.hint("merge"), edges["b"] == lower["at"], "left").select("a", "b", "m"), "pointed")
        n, chained = pointed.agg(F.count(F.lit(1)), F.count("m")).first()
        done = not chained and n == lower.count()
        discard(spark, lower_path)
        if done:
            discard(spark, pointed_path)
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # large-star: neighbours above a node go to its smallest neighbour; small-star: those below it, and itself, to the smallest
        large, large_path = written_at(pointed.select("a", F.coalesce("m", "b").alias("b")).distinct(), "large")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges, new = written_at(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(spark, path, pointed_path, large_path)
        path = new
