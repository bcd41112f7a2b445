"""The ladder of event-history models: held-out code length, with durations and parameters charged.

Rung 0 knows how often states follow, rung 1 what follows which state; both pay for durations by one pooled table over bins of
elapsed frames. Rung 2 is a hazard per context: in every frame a run stays or leaves for one of the other states, given its
state, its last k (state, duration bin) pairs and any covariates, and the bin of the frames elapsed; it needs no other
duration model. Counts are one sparse table (k, context, bin, next state); contexts that were never fitted are not in it and are left
with the added weight alone.

A run is one row per context length and per bin it reaches, never one per frame. Tables are keyed by context, as large as what was observed,
and joined without hints.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.operators.eventhistory import ALPHA, OPEN_END, bin_of

RUN = ("recording", "run_id")


def elapsed(edges: list[int]) -> Column:
    """Bin of a run's last frame, counted from 0."""
    return bin_of(F.greatest(F.col("duration") - 1, F.lit(0)), edges)


def pooled_durations(fit: DataFrame, edges: list[int], alpha: float = ALPHA) -> DataFrame:
    """(bin, duration_nats): a bin's smoothed share, spread evenly over its whole durations; the open bin ends with the longest run."""
    bins = len(edges) - 1
    found = fit.agg(*[F.count(F.when(elapsed(edges) == b, 1)).alias(f"n{b}") for b in range(bins)], F.max("duration").alias("longest"))
    last = F.greatest(F.col("longest") - edges[-2], F.lit(1)) if edges[-1] == OPEN_END else F.lit(edges[-1] - edges[-2])
    widths = [F.lit(edges[b + 1] - edges[b]) for b in range(bins - 1)] + [F.coalesce(last, F.lit(1))]
    total = sum((F.col(f"n{b}") for b in range(bins)), F.lit(0))
    nats = [F.log(w) - F.log(F.col(f"n{b}") + alpha) + F.log(total + alpha * bins) for b, w in enumerate(widths)]
    return found.select(F.posexplode(F.array(*nats)).alias("bin", "duration_nats"))


def with_contexts(prepared: DataFrame, edges: list[int], ks: Sequence[int], covariates: Sequence[str] = ()) -> DataFrame:
    """One row per run and k: adds k and context, the covariates, the code, and the last k (code, bin) pairs of kept runs of the recording."""
    order = Window.partitionBy("recording").orderBy("run_id")
    pair = F.concat_ws(":", F.col("code"), elapsed(edges))
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in covariates] + [F.col("code").cast("string")]
    past = [F.coalesce(F.lag(pair, i).over(order), F.lit("-")) for i in range(1, max(ks) + 1)]
    lagged = prepared.withColumns({f"_past{i}": p for i, p in enumerate(past, 1)})
    keys = [F.struct(F.lit(k).alias("k"), F.concat_ws("|", *own, *[F.col(f"_past{i}") for i in range(1, k + 1)]).alias("context")) for k in ks]
    return lagged.withColumn("_c", F.explode(F.array(*keys))).select(*prepared.columns, "_c.k", "_c.context")


def by_bin(runs: DataFrame, edges: list[int]) -> DataFrame:
    """One row per bin that a run reaches: bin, stays (frames it stayed in it) and leaves (whether it left in it)."""
    last = F.greatest(F.col("duration") - 1, F.lit(0))
    bins = F.array(*[F.struct(F.lit(b).alias("bin"), F.lit(edges[b]).cast("long").alias("lo"), F.lit(edges[b + 1]).cast("long").alias("hi")) for b in range(len(edges) - 1)])
    reached = F.filter(bins, lambda x: x["lo"] <= last)
    out = runs.withColumn("_b", F.explode(reached))
    stays = F.least(last, F.col("_b.hi")) - F.col("_b.lo")
    leaves = ~F.col("censored") & (last < F.col("_b.hi"))
    return out.select(*runs.columns, "_b.bin", stays.alias("stays"), leaves.alias("leaves"))


def hazard_counts(fit: DataFrame, edges: list[int]) -> DataFrame:
    """(k, context, bin, next_state, stays, exits) of runs with contexts; next_state is null where runs only stayed."""
    to = F.when(F.col("leaves"), F.col("next_state"))
    counted = by_bin(fit, edges).groupBy("k", "context", "bin", to.alias("next_state"))
    return counted.agg(F.sum("stays").alias("stays"), F.sum(F.col("leaves").cast("long")).alias("exits"))


def cells(counts: DataFrame) -> DataFrame:
    """(k, context, bin, at_risk, left): frames at risk and exits of each observed cell."""
    at = counts.groupBy("k", "context", "bin").agg((F.sum("stays") + F.sum("exits")).alias("at_risk"), F.sum("exits").alias("left"))
    return at.where("at_risk > 0")


def hazard_nats(counts: DataFrame, report: DataFrame, edges: list[int], n_states: int, alpha: float = ALPHA) -> DataFrame:
    """(recording, run_id, k, nats): what the stays and the exit of each run with contexts cost."""
    seen = counts.where("exits > 0").select("k", "context", "bin", F.col("next_state").alias("_to"), F.col("exits").alias("_n"))
    rows = by_bin(report, edges).withColumn("_to", F.when(F.col("leaves"), F.col("next_state")))
    rows = rows.join(cells(counts), ["k", "context", "bin"], "left").join(seen, ["k", "context", "bin", "_to"], "left")
    none = F.lit(0)
    whole = F.log(F.coalesce("at_risk", none) + alpha * n_states)
    stay = whole - F.log(F.coalesce(F.col("at_risk") - F.col("left"), none) + alpha)
    leave = whole - F.log(F.coalesce("_n", none) + alpha)
    nats = F.col("stays") * stay + F.when(F.col("leaves"), leave).otherwise(0.0)
    return rows.groupBy(*RUN, "k").agg(F.sum(nats).alias("nats"))


def table_nats(fit: DataFrame, report: DataFrame, edges: list[int], n_states: int, alpha: float = ALPHA) -> DataFrame:
    """Adds rung0 and rung1, nats of each run; a censored run pays for its duration only, a run that repeats itself is refused."""
    pairs = fit.where("not censored and code <> next_state").groupBy("code", "next_state").agg(F.count(F.lit(1)).alias("_n"))
    after = pairs.groupBy("code").agg(F.sum("_n").alias("_row"))
    marginal = fit.where("not censored").groupBy("next_state").agg(F.count(F.lit(1)).alias("_m"))
    total = fit.where("not censored").agg(F.count(F.lit(1)).alias("_all"))
    df = report.withColumn("bin", elapsed(edges)).join(pooled_durations(fit, edges, alpha), "bin", "left")
    df = df.join(marginal, "next_state", "left").join(after, "code", "left").join(pairs, ["code", "next_state"], "left").crossJoin(F.broadcast(total))  # one row
    none = F.lit(0)
    zero = F.log(F.col("_all") + alpha * n_states) - F.log(F.coalesce("_m", none) + alpha)
    one = F.log(F.coalesce("_row", none) + alpha * (n_states - 1)) - F.log(F.coalesce("_n", none) + alpha)
    again = F.raise_error(F.lit("a scored run is followed by its own state: runs were joined over a seam or an abstaining run was cut out")).cast("double")
    symbol = lambda c: F.when(F.col("censored"), 0.0).when(F.col("code") == F.col("next_state"), again).otherwise(c)
    return df.select(*report.columns, (F.col("duration_nats") + symbol(zero)).alias("rung0"), (F.col("duration_nats") + symbol(one)).alias("rung1"))


def score(fit: DataFrame, report: DataFrame, edges: list[int], n_states: int, ks: Sequence[int] = (0, 1, 2), alpha: float = ALPHA, covariates: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """All rungs at once: (recording, run_id, rung, k, nats) of held-out runs, and (rung, k, n_params)."""
    spark, a, bins = fit.sparkSession, n_states, len(edges) - 1
    tables = table_nats(fit, report, edges, a, alpha)
    low = tables.select(*RUN, F.explode(F.array(*[F.struct(F.lit(r).alias("rung"), F.lit(0).alias("k"), F.col(f"rung{r}").alias("nats")) for r in (0, 1)])).alias("s")).select(*RUN, "s.*")
    counts = hazard_counts(with_contexts(fit, edges, ks, covariates), edges)
    high = hazard_nats(counts, with_contexts(report, edges, ks, covariates), edges, a, alpha)
    fixed = spark.createDataFrame([(0, 0, (a - 1) + (bins - 1)), (1, 0, a * (a - 2) + (bins - 1))], "rung int, k int, n_params long")
    free = cells(counts).groupBy("k").agg((F.count(F.lit(1)) * (a - 1)).alias("n_params"))
    params = fixed.unionByName(free.select(F.lit(2).alias("rung"), "k", "n_params"))
    return low.unionByName(high.select(*RUN, F.lit(2).alias("rung"), "k", "nats")), params


def parameter_charge(n_fit: Column) -> Column:
    """Nats per parameter: half the logarithm of the number of fitted runs."""
    return 0.5 * F.log(F.greatest(n_fit, F.lit(2)).cast("double"))


def code_length(scored: DataFrame, params: DataFrame, n_fit: DataFrame, fps: float) -> DataFrame:
    """One row per rung and k, the terms apart: data, codebook, seconds, and nats per second and run.

    ``scored`` has duration and nats, ``n_fit`` one row with the number of fitted runs.
    """
    sums = scored.groupBy("rung", "k").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("nats").alias("data_nats"), (F.sum("duration") / fps).alias("t_seconds"))
    out = sums.join(params, ["rung", "k"]).crossJoin(F.broadcast(n_fit))  # one row
    book = F.col("n_params") * parameter_charge(F.col("n_fit"))
    out = out.withColumns({"codebook_nats": book, "total_nats": F.col("data_nats") + book})
    per = lambda c, by: F.try_divide(F.col(c), F.col(by))
    return out.withColumns({"nats_per_second": per("total_nats", "t_seconds"), "data_nats_per_second": per("data_nats", "t_seconds"), "nats_per_run": per("data_nats", "n_runs")})


def per_animal(scored: DataFrame, params: DataFrame, n_fit: DataFrame, fps: float) -> DataFrame:
    """(rung, k, animal, t_seconds, nats_per_second), the codebook shared out by time, so each animal bears the same offset."""
    own = scored.groupBy("rung", "k", "animal").agg(F.sum("nats").alias("nats"), (F.sum("duration") / fps).alias("t_seconds"))
    total = own.groupBy("rung", "k").agg(F.sum("t_seconds").alias("t_total")).join(params, ["rung", "k"]).crossJoin(F.broadcast(n_fit))  # one row
    offset = total.select("rung", "k", (F.col("n_params") * parameter_charge(F.col("n_fit")) / F.col("t_total")).alias("offset"))
    return own.join(offset, ["rung", "k"]).withColumn("nats_per_second", F.try_divide(F.col("nats"), F.col("t_seconds")) + F.col("offset"))
