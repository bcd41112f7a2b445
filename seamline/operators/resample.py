"""Resampling with draws that data decides: a uniform is the head of an md5 of seed and keys, the same in any engine.

Draws are columns, so replicates are rows and intervals are plain aggregates; nothing depends on partitions or order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(*parts: Column | str | int) -> Column:
    """Integer in [0, 2**32) from the joined parts."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("bigint")


def cluster_interval(values: DataFrame, cluster: str, value: str, weight: str, seed: int = 1, n_boot: int = 200, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of a weighted mean under resampling of whole clusters with replacement; one row.

    Clusters are summed first, so a replicate moves one row per cluster: n_boot times the number of clusters.
    """
    spark = values.sparkSession
    sums = values.groupBy(cluster).agg(F.sum(F.col(value) * F.col(weight)).alias("vw"), F.sum(weight).alias("w"))
    ranked = sums.withColumn("i", F.row_number().over(_by(cluster)) - 1)
    size = sums.agg(F.count(F.lit(1)).alias("g"), (F.sum("vw") / F.sum("w")).alias("point"))
    slots = ranked.select("i").crossJoin(F.broadcast(spark.range(n_boot).withColumnRenamed("id", "rep"))).crossJoin(F.broadcast(size))
    slots = slots.withColumn("pick", F.pmod(draw(seed, F.col("rep"), F.col("i")), F.col("g")).cast("int"))
    reps = slots.join(ranked.select(F.col("i").alias("pick"), "vw", "w"), "pick").groupBy("rep", "point", "g").agg((F.sum("vw") / F.sum("w")).alias("m"))
    q = lambda p: F.percentile("m", p)
    return reps.agg(F.max("point").alias("point"), q(alpha / 2).alias("lo"), q(1 - alpha / 2).alias("hi"), F.max("g").cast("bigint").alias("n_clusters"))


def _by(key: str):
    from pyspark.sql import Window

    return Window.orderBy(key)  # over one row per cluster


def sign_flip(diffs: DataFrame, key: str, value: str, seed: int = 2, n_rep: int = 200) -> DataFrame:
    """Two-sided p of a mean difference under random signs, one sign per pair and replicate; one row."""
    spark = diffs.sparkSession
    reps = diffs.crossJoin(F.broadcast(spark.range(n_rep).withColumnRenamed("id", "rep")))
    sign = F.when(draw(seed, F.col("rep"), F.col(key)) % 2 == 0, 1).otherwise(-1)
    null = reps.groupBy("rep").agg(F.avg(F.col(value) * sign).alias("m"))
    obs = diffs.agg(F.avg(value).alias("obs"), F.count(F.lit(1)).alias("n"))
    out = null.crossJoin(F.broadcast(obs))  # one row
    return out.groupBy("obs", "n").agg(((F.sum((F.abs(F.col("m")) >= F.abs(F.col("obs")) - 1e-12).cast("int")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"), F.avg("m").alias("null_mean"))


def subsample(df: DataFrame, key: str, n: int, seed: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` rows of lowest draw (per group): a sampling operator, so the bound is its purpose."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by) if by else Window.partitionBy()
    if by:
        return df.withColumn("_r", F.row_number().over(w.orderBy(draw(seed, F.col(key)), key))).where(F.col("_r") <= n).drop("_r")
    return df.orderBy(draw(seed, F.col(key)), key).limit(n)


def jackknife(sums: DataFrame, cluster: str) -> DataFrame:
    """Leave-one-cluster-out standard error of sum(vw) / sum(w), from (cluster, vw, w); one row."""
    total = sums.agg(F.sum("vw").alias("tv"), F.sum("w").alias("tw"), F.count(F.lit(1)).alias("g"))
    out = sums.crossJoin(F.broadcast(total)).withColumn("m", F.try_divide(F.col("tv") - F.col("vw"), F.col("tw") - F.col("w")))  # one row
    return out.agg(F.max(F.col("tv") / F.col("tw")).alias("theta"), F.sqrt((F.max("g") - 1) * F.var_pop("m")).alias("se"), F.max("g").alias("n_clusters"))
