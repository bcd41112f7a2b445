"""Summaries along recordings: equal windows, polynomial fits, templates, permuted controls, false discoveries, reversals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.operators.resample import draw


def equal_windows(frames: DataFrame, value: str, parts: int = 8, least: int = 1) -> DataFrame:
    """Mean and population deviation of a value in ``parts`` equal windows of each recording."""
    n = F.count(F.lit(1)).over(Window.partitionBy("recording"))
    part = F.floor((parts * (F.col("t") + 1) - 1) / n).cast("int")
    out = frames.withColumn("part", part).groupBy("recording", "part").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return out.where(F.col("n") >= least)


def causal_mean(frames: DataFrame, value: str, width: int, out: str) -> DataFrame:
    """Mean of the ``width`` frames before; NULL until there are that many."""
    w = Window.partitionBy("recording").orderBy("t")
    full = F.row_number().over(w) > width
    return frames.withColumn(out, F.when(full, F.avg(value).over(w.rowsBetween(-width, -1))))


def cubic_fit(frames: DataFrame, by: list[str], value: str) -> DataFrame:
    """R2 of a cubic over each group's equally spaced frames, from projections on orthogonal polynomials; groups of 5 or more.

    On n equal steps around their middle u, the polynomials 1, u, u^2 - (n^2 - 1) / 12 and u^3 - u (3 n^2 - 7) / 20 are
    orthogonal, so that each sum of squares is explained apart and no system has to be solved.
    """
    g = Window.partitionBy(*by)
    df = frames.withColumns({"_n": F.count(F.lit(1)).over(g), "_m": F.avg("t").over(g), "_y": F.avg(value).over(g)}).where("_n >= 5")
    u, n = F.col("t") - F.col("_m"), F.col("_n")
    basis = [u, u**2 - (n**2 - 1) / 12, u**3 - u * (3 * n**2 - 7) / 20]
    y = F.col(value) - F.col("_y")
    sums = [F.sum(b * y).alias(f"s{i}") for i, b in enumerate(basis)] + [F.sum(b * b).alias(f"q{i}") for i, b in enumerate(basis)]
    out = df.groupBy(*by, "_n").agg(*sums, F.sum(y * y).alias("sst"))
    explained = sum(F.col(f"s{i}") ** 2 / F.col(f"q{i}") for i in range(3))
    r2 = F.try_divide(explained, F.col("sst"))
    return out.select(*by, F.col("_n").alias("n"), r2.alias("r2"), (1 - (1 - r2) * (F.col("_n") - 1) / (F.col("_n") - 4)).alias("r2_adj"))


def template(frames: DataFrame, value: str, width: int, count: int, seed: str = "template") -> DataFrame:
    """Mean by offset of ``count`` drawn windows of ``width`` frames; a sampling operator."""
    n = F.count(F.lit(1)).over(Window.partitionBy("recording"))
    starts = frames.withColumn("_n", n).where(F.col("t") + width <= F.col("_n"))
    starts = starts.orderBy(draw(seed, F.col("recording"), F.col("t")), "recording", "t").limit(count).select("recording", F.col("t").alias("s"))
    hit = starts.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("t", F.col("s") + F.col("offset"))
    return frames.join(F.broadcast(hit), ["recording", "t"]).groupBy("offset").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def reverse(frames: DataFrame, columns: list[str], shift: int = 1) -> DataFrame:
    """Time reversal of frame-to-next quantities: negated, and read from frame n - 1 - shift - t."""
    n = F.count(F.lit(1)).over(Window.partitionBy("recording"))
    back = frames.withColumn("_n", n).withColumn("t", F.col("_n") - 1 - shift - F.col("t")).where("t >= 0")
    return back.select("recording", "t", *[(-F.col(c)).alias(c) for c in columns])


def false_discoveries(p: DataFrame, value: str = "p", q: float = 0.1) -> DataFrame:
    """Benjamini-Hochberg: adds rank and rejected; one row per test, so one small window."""
    rank = F.row_number().over(Window.orderBy(value, *[c for c in p.columns if c != value]))
    m = F.count(F.lit(1)).over(Window.partitionBy())
    df = p.withColumns({"rank": rank, "_m": m})
    last = F.max(F.when(F.col(value) <= q * F.col("rank") / F.col("_m"), F.col("rank"))).over(Window.partitionBy())
    return df.withColumn("rejected", F.coalesce(F.col("rank") <= last, F.lit(False))).drop("_m")


def r2(df: DataFrame, by: list[str], truth: str, guess: str) -> DataFrame:
    both = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    mean = both.groupBy(*by).agg(F.avg(truth).alias("_m"))
    out = both.join(mean, by).groupBy(*by).agg(F.sum((F.col(truth) - F.col(guess)) ** 2).alias("res"), F.sum((F.col(truth) - F.col("_m")) ** 2).alias("tot"), F.count(F.lit(1)).alias("n"))
    return out.select(*by, "n", (1 - F.try_divide(F.col("res"), F.col("tot"))).alias("r2"))
