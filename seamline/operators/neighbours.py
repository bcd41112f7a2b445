"""Sequence distances and threshold graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.operators.segments import durable


def open_end(a: Column, b: Column) -> Column:
    """Root mean square difference over the shared prefix; null without one."""
    m = F.least(F.size(a), F.size(b))
    sq = F.zip_with(F.slice(a, F.lit(1), m), F.slice(b, F.lit(1), m), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.try_divide(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x), m))


def union_end(a: Column, b: Column) -> Column:
    """The same over the longer one's length, the shorter one holding its last value; null if one is empty."""
    m, both = F.greatest(F.size(a), F.size(b)), (F.size(a) > 0) & (F.size(b) > 0)
    pad = lambda x: F.concat(x, F.array_repeat(F.try_element_at(x, F.lit(-1)), m - F.size(x)))
    sq = F.zip_with(pad(a), pad(b), lambda x, y: (x - y) * (x - y))
    return F.when(both, F.sqrt(F.try_divide(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x), m)))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (unit, component): the smallest unit that edges reach, by minimum labels that also jump to their label's label.

    Rounds go on until no label falls any more."""
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = durable(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).select(F.col("a").alias("unit"), "c"))
    while True:
        near = both.join(labels.select(F.col("unit").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("n"))
        step = labels.join(near.withColumnRenamed("a", "unit"), "unit").select("unit", F.least("c", "n").alias("n"), F.col("c").alias("was"))
        jump = step.join(labels.select(F.col("unit").alias("n"), F.col("c").alias("j")), "n", "left")
        new = durable(jump.select("unit", F.least("n", F.coalesce("j", "n")).alias("c"), "was"))
        labels = new.select("unit", "c")
        if new.where("c <> was").isEmpty():
            return labels.withColumnRenamed("c", "component")
