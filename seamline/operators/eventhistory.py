"""Event-history operators on prepared runs: transition counts, duration models, hazards, held-out code length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 1.0
#: No run lasts longer.
OPEN_END = (1 << 63) - 1


def duration_edges(runs: DataFrame, n_bins: int = 12, q: float = 0.999) -> list[int]:
    """Bin edges on the driver: log-spaced up to a duration quantile, between 0 and the open end. One scalar is collected."""
    import math

    top = runs.agg(F.percentile("duration", q)).first()[0] or 1.0
    top = max(float(top), 2.0)
    inner = sorted({max(1, round(math.exp(math.log(top) * i / (n_bins - 1)))) for i in range(n_bins)})
    return [0, *inner, OPEN_END]


def bin_of(value: Column, edges: list[int]) -> Column:
    """Index of the half-open bin that holds a value."""
    return sum((value >= e).cast("int") for e in edges[1:-1]) if len(edges) > 2 else F.lit(0)


def transition_counts(prepared: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return prepared.where("not censored").groupBy(*by, "code", "next_state").agg(F.count(F.lit(1)).alias("n"))


def duration_pmf(prepared: DataFrame, edges: list[int], alpha: float = ALPHA) -> DataFrame:
    """(bin, nats): minus log of the smoothed bin share spread evenly over the bin's width; the open bin ends after the longest run."""
    spark = prepared.sparkSession
    n_bins = len(edges) - 1
    rows = [(b, edges[b], edges[b + 1]) for b in range(n_bins)]
    grid = F.broadcast(spark.createDataFrame(rows, "bin int, lo long, hi long"))  # as many rows as bins
    counts = prepared.groupBy(bin_of(F.col("duration"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = prepared.agg(F.count(F.lit(1)).alias("total"), F.max("duration").alias("longest"))
    out = grid.join(counts, "bin", "left").crossJoin(F.broadcast(total))  # a one-row frame
    hi = F.when(F.col("hi") == OPEN_END, F.greatest(F.col("longest"), F.col("lo") + 1)).otherwise(F.col("hi"))
    width = F.greatest(hi - F.col("lo"), F.lit(1))
    share = (F.coalesce("n", F.lit(0)) + alpha) / (F.col("total") + alpha * n_bins)
    return out.select("bin", (F.log(width) - F.log(share)).alias("dur_nats"))


def rungs(fit: DataFrame, report: DataFrame, edges: list[int], n_states: int, alpha: float = ALPHA) -> DataFrame:
    """Nats of each held-out run under rung 0 (marginal next symbol) and rung 1 (first-order transitions).

    Adds dur_nats, sym0, sym1; a censored run pays no symbol. Models are as small as the alphabet, and broadcast.
    """
    pmf = F.broadcast(duration_pmf(fit, edges, alpha))
    counts = transition_counts(fit)
    total = counts.agg(F.sum("n").alias("total"))
    marginal = counts.groupBy("next_state").agg(F.sum("n").alias("m"))
    rows = counts.groupBy("code").agg(F.sum("n").alias("r"))
    df = report.withColumn("bin", bin_of(F.col("duration"), edges)).join(pmf, "bin", "left")
    df = df.join(F.broadcast(marginal), "next_state", "left").join(F.broadcast(rows), "code", "left")
    df = df.join(F.broadcast(counts), ["code", "next_state"], "left").crossJoin(F.broadcast(total))
    sym0 = F.log(F.coalesce("total", F.lit(0)) + alpha * n_states) - F.log(F.coalesce("m", F.lit(0)) + alpha)
    sym1 = F.log(F.coalesce("r", F.lit(0)) + alpha * (n_states - 1)) - F.log(F.coalesce("n", F.lit(0)) + alpha)
    free = F.col("censored")
    return df.withColumns({"sym0": F.when(free, 0.0).otherwise(sym0), "sym1": F.when(free, 0.0).otherwise(sym1)})


def hazard(prepared: DataFrame, edges: list[int], by: tuple[str, ...] = ("code",)) -> DataFrame:
    """Frames at risk and exits per context and duration bin, by overlap of a run with the bins, never per frame.

    A run of d frames is at risk d - 1 frames without an exit, and once more in the bin of its last frame if it exits.
    """
    n_bins = len(edges) - 1
    bins = F.array(*[F.struct(F.lit(b).alias("bin"), F.lit(edges[b]).alias("lo"), F.lit(edges[b + 1]).alias("hi")) for b in range(n_bins)])
    last = F.col("duration") - 1
    df = prepared.select(*by, "duration", "censored", F.explode(bins).alias("b"))
    stay = F.greatest(F.least(last, F.col("b.hi")) - F.col("b.lo"), F.lit(0))
    leaves = (~F.col("censored")) & (last >= F.col("b.lo")) & (last < F.col("b.hi"))
    out = df.groupBy(*by, F.col("b.bin").alias("bin")).agg(F.sum(stay + leaves.cast("int")).alias("at_risk"), F.sum(leaves.cast("bigint")).alias("exits"))
    return out.where("at_risk > 0").withColumn("hazard", F.col("exits") / F.col("at_risk"))


def hazard_nats(model: DataFrame, report: DataFrame, edges: list[int], alpha: float = ALPHA) -> DataFrame:
    """Adds nats: minus the log-likelihood of a run's survival and exit under a smoothed hazard (code, bin, at_risk, exits)."""
    n_bins = len(edges) - 1
    bins = F.array(*[F.struct(F.lit(b).alias("bin"), F.lit(edges[b]).alias("lo"), F.lit(edges[b + 1]).alias("hi")) for b in range(n_bins)])
    last = F.col("duration") - 1
    df = report.select("*", F.explode(bins).alias("b")).withColumn("bin", F.col("b.bin"))
    df = df.where(last >= F.col("b.lo")).join(F.broadcast(model.select("code", "bin", "at_risk", "exits")), ["code", "bin"], "left")
    at, ex = F.coalesce("at_risk", F.lit(0)) + 2 * alpha, F.coalesce("exits", F.lit(0)) + alpha
    stay = F.greatest(F.least(last, F.col("b.hi")) - F.col("b.lo"), F.lit(0))
    leaves = (~F.col("censored")) & (last < F.col("b.hi"))
    nats = stay * (F.log(at) - F.log(at - ex)) + F.when(leaves, F.log(at) - F.log(ex)).otherwise(0.0)
    return df.withColumn("nats", nats).groupBy("recording", "animal", "run_id").agg(F.sum("nats").alias("nats"))


def history(prepared: DataFrame, edges: list[int], k: int) -> DataFrame:
    """Adds key: the code and the last k (code, duration bin) pairs of the kept runs, '-' before a recording's start."""
    w = Window.partitionBy("recording").orderBy("run_id")
    item = F.concat_ws(":", F.col("code"), bin_of(F.col("duration"), edges))
    parts = [F.col("code").cast("string")] + [F.coalesce(F.lag(item, i).over(w), F.lit("-")) for i in range(1, k + 1)]
    return prepared.withColumn("key", F.concat_ws("|", *parts))
