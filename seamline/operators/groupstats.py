"""Statistics over groups: dispersion, concentration, quantile profiles, rank correlations, weighted pools."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.operators.segments import durable


def group_counts(df: DataFrame, by: Sequence[str], mask: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(F.col(mask).cast("bigint")).alias("k"), F.count(F.lit(1)).alias("n"))


def dispersion(counts: DataFrame) -> DataFrame:
    """Observed variance of group rates over the mean binomial variance; one row from counts (k, n)."""
    rate = F.col("k") / F.col("n")
    pooled = counts.agg((F.sum("k") / F.sum("n")).alias("p"))
    out = counts.crossJoin(F.broadcast(pooled))  # one row
    expected = F.avg(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return out.agg(F.var_samp(rate).alias("observed"), expected.alias("expected"), F.count(F.lit(1)).alias("groups")).withColumn("ratio", F.try_divide(F.col("observed"), F.col("expected")))


def lorenz(counts: DataFrame, key: str, shares: Sequence[float] = (0.01, 0.05, 0.1, 0.25)) -> DataFrame:
    """Share of all counts in the top groups, and the Gini index. Ranks run over one row per group, not over the input."""
    down = Window.orderBy(F.desc("k"), F.asc(key))
    up = Window.orderBy(F.asc("k"), F.asc(key))
    ranked = counts.withColumns({"hi": F.row_number().over(down), "lo": F.row_number().over(up)})
    total = counts.agg(F.count(F.lit(1)).alias("g"), F.sum("k").alias("s"))
    ranked = ranked.crossJoin(F.broadcast(total))  # one row
    tops = [F.try_divide(F.sum(F.when(F.col("hi") <= F.greatest(F.lit(1), F.bround(F.col("g") * s)), F.col("k")).otherwise(0)), F.max("s")).alias(f"top_{round(s * 100)}") for s in shares]
    gini = F.try_divide(F.sum((2 * F.col("lo") - F.col("g") - 1) * F.col("k")), F.max("g") * F.max("s"))
    return ranked.agg(*tops, gini.alias("gini"))


def quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> list[float]:
    """Exact quantiles of a whole column, linearly interpolated, without a task that sees all of it.

    Rows are counted by value, values dealt by ranges, and the ranges' sizes tell in which one a rank lies and how far in.
    The driver sees a row per range and two per quantile.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = durable(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    parts = counts.groupBy("part").agg(F.min("v").alias("least"), F.sum("n").alias("n")).orderBy("least").collect()
    total = sum(r["n"] for r in parts)
    if not total:
        return []
    spots = [p * (total - 1) for p in probs]
    before, wanted = 0, {}
    for r in parts:
        own = sorted({k for x in spots for k in (math.floor(x), math.ceil(x)) if before <= k < before + r["n"]})
        if own:
            wanted[r["part"]] = (before, own)
        before += r["n"]
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    rows = counts.where(F.col("part").isin(list(wanted))).withColumn("upto", upto)
    hit = F.lit(False)
    for part, (start, own) in wanted.items():
        for k in own:
            hit = hit | ((F.col("part") == part) & (F.col("upto") > k - start) & (F.col("upto") - F.col("n") <= k - start))
    at = {}
    for r in rows.where(hit).collect():
        start, own = wanted[r["part"]]
        at |= {k: float(r["v"]) for k in own if r["upto"] - r["n"] <= k - start < r["upto"]}
    return [at[math.floor(x)] + (at[math.ceil(x)] - at[math.floor(x)]) * (x - math.floor(x)) for x in spots]


def quantile_edges(df: DataFrame, value: str, n_bins: int) -> list[float]:
    """Distinct quantile edges of a value."""
    return sorted(set(quantiles(df, value, [i / n_bins for i in range(n_bins + 1)])))


def bucket(value: Column, edges: Sequence[float]) -> Column:
    """Edges at or under the value, less one, clipped to the bins."""
    return F.least(F.greatest(sum((value >= e).cast("int") for e in edges) - 1, F.lit(0)), F.lit(len(edges) - 2))


def profile(df: DataFrame, value: str, mask: str, n_bins: int = 10) -> DataFrame:
    """Rate of a mask by quantile bin of a value."""
    out = df.withColumn("bin", bucket(F.col(value), quantile_edges(df, value, n_bins)))
    return out.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(mask).cast("int")).alias("rate"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def average_rank(column: str, by: Sequence[str]) -> Column:
    ties = Window.partitionBy(*by, column)
    return F.rank().over(Window.partitionBy(*by).orderBy(column)) + (F.count(F.lit(1)).over(ties) - 1) / 2


def spearman(df: DataFrame, by: str, x: str, y: str, least: int = 30) -> DataFrame:
    """Rank correlation per group with average ranks; groups need ``least`` rows and two distinct values of each."""
    ranked = df.withColumns({"_x": average_rank(x, [by]), "_y": average_rank(y, [by])})
    out = ranked.groupBy(by).agg(F.corr("_x", "_y").alias("rho"), F.count(F.lit(1)).alias("n"), F.count_distinct(x).alias("dx"), F.count_distinct(y).alias("dy"))
    return out.where((F.col("n") >= least) & (F.col("dx") >= 2) & (F.col("dy") >= 2)).select(by, "n", "rho")


def partial_spearman(df: DataFrame, by: str, x: str, y: str, z: str, least: int = 30) -> DataFrame:
    """Rank correlation of x and y per group, with z held."""
    ranked = df.withColumns({"_x": average_rank(x, [by]), "_y": average_rank(y, [by]), "_z": average_rank(z, [by])})
    out = ranked.groupBy(by).agg(F.corr("_x", "_y").alias("xy"), F.corr("_x", "_z").alias("xz"), F.corr("_y", "_z").alias("yz"), F.count(F.lit(1)).alias("n"))
    den = F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))
    return out.where((F.col("n") >= least) & (den >= 1e-9)).select(by, "n", ((F.col("xy") - F.col("xz") * F.col("yz")) / den).alias("rho"))


def pooled(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean; sums are added before they are divided."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"), F.sum(weight).alias("weight"))


def quartiles_within(df: DataFrame, group: Sequence[str], value: str, tie: Sequence[str], m: int = 4) -> DataFrame:
    """Adds quartile by stable rank within the group, cut at floor(n q / m); -1 in groups under m rows."""
    w = Window.partitionBy(*group).orderBy(value, *tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    q = F.floor((m * F.row_number().over(w) - 1) / n).cast("int")
    return df.withColumn("quartile", F.when(n < m, -1).otherwise(q))


def total_variation(counts: DataFrame, side: str, key: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Half the summed difference of two sides' shares; sides are TRUE and FALSE, counts in n."""
    total = counts.groupBy(*by).agg(F.sum(F.when(F.col(side), F.col("n"))).alias("ta"), F.sum(F.when(~F.col(side), F.col("n"))).alias("tb"))
    per = counts.groupBy(*by, *key).agg(F.sum(F.when(F.col(side), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col(side), F.col("n")).otherwise(0)).alias("b"))
    out = per.join(total, list(by))
    return out.groupBy(*by).agg((0.5 * F.sum(F.abs(F.col("a") / F.col("ta") - F.col("b") / F.col("tb")))).alias("tv"), F.max("ta").alias("n_a"), F.max("tb").alias("n_b"))
