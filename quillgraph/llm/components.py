"""Connected components of an edge table by alternating large-star and small-star contraction, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget_stored, stored, stored_few, stored_so_far


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its larger (or smaller) neighbours to the least node it sees."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.where("b < a")
    least = seen.groupBy("a").agg(F.min("b").alias("m"))
    joined = seen.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a != b")
    return joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether they are stars: no node with a smaller neighbour has another edge."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    n, loose = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 0 and n > 1"))).first()
    return n, loose == 0


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, label): the least node reachable, for each node with an edge, written; what it was made from is deleted. edges: a, b (long). No edge: no row."""
    spark, mark = edges.sparkSession, stored_so_far()
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        n, settled = _state(edges)
        if settled:
            break
        for large in (True, False):
            edges = stored_few(_stars(edges, large).distinct(), 2 * n)
            forget_stored(spark, mark, but=1)
    else:
        raise RuntimeError("components did not settle")
    labels = stored_few(edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), 2 * n)
    forget_stored(spark, mark, but=1)
    return labels
