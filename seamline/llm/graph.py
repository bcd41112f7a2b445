"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import durable, release


def _stars(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v), u over v, are stars about their smallest vertices: no u has two edges or is a v."""
    ends = F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))
    met = edges.select(F.explode(ends).alias("end")).groupBy("end.x").agg(F.sum("end.up").alias("n"), F.min("end.up").alias("low"))
    return met.where("n > 1 or n = 1 and low = 0").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges, of any orderable type, to (vertex, root), root being the smallest vertex that links reach.

    Each round replaces every edge by one to the smallest neighbour, first towards larger vertices, then towards smaller
    ones (large star, small star); the number of rounds grows with the logarithm of the number of vertices. A vertex'
    neighbours are never collected: minima are partial aggregates, and the joins back are by key, which adaptive
    execution splits where a vertex has very many. Each round is written to the checkpoint folder. Vertices without an
    edge are not in the result.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = durable(e)
    while not _stars(e):  # every round that changes an edge lowers an end of it, so rounds end
        # Large star: every vertex sends its larger neighbours to its smallest one.
        ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = e.select(F.explode(ways).alias("way")).select("way.u", "way.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every vertex sends its smaller neighbours, and itself, to the smallest.
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        sent = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(sent.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        release(edges.sparkSession)
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
