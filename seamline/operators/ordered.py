"""Seam-safe operators on ordered recordings: runs, islands, neighbours in time, smoothing.

Every window is partitioned by the recording, so no value depends on another recording's rows; and every window has a
total order. A recording is one partition of its window: rows of one recording move together, recordings spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.sources.adapters import ABSTAIN


def _order(by: Sequence[str], t: str = "t"):
    return Window.partitionBy(*by).orderBy(t)


def encode(frames: DataFrame, keep: Sequence[str] = (), code: str = "code") -> DataFrame:
    """Run-length encoding: recording, run_id, code, start_t, end_t (exclusive), duration, and ``keep`` columns.

    ``keep`` names columns that are constant in a recording.
    """
    w = _order(["recording"])
    new = F.when(F.lag(code).over(w).eqNullSafe(F.col(code)), 0).otherwise(1)
    runs = frames.withColumn("_new", new).withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    return (
        runs.groupBy("recording", *keep, "run_id")
        .agg(F.first(code).alias("code"), F.min("t").alias("start_t"), (F.max("t") + 1).alias("end_t"), F.count(F.lit(1)).alias("duration"))
    )


def islands(frames: DataFrame, mask: str, keep: Sequence[str] = ()) -> DataFrame:
    """Maximal TRUE runs of a mask as half-open ranges: recording, start, stop, n_frames."""
    runs = encode(frames.withColumn("_mask", F.coalesce(F.col(mask), F.lit(False))), keep, code="_mask").where("code")
    return runs.select("recording", *keep, F.col("start_t").alias("start"), F.col("end_t").alias("stop"), F.col("duration").alias("n_frames"))


def sequences(runs: DataFrame, gap: int = ABSTAIN) -> DataFrame:
    """Collapsed code sequences, split at seams and at the gap code: recording, seq, codes, n_runs."""
    w = _order(["recording"], "run_id")
    cut = F.sum(F.when(F.col("code") == gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = runs.withColumn("seq", cut).where(F.col("code") != gap)
    out = kept.groupBy("recording", "seq").agg(F.sort_array(F.collect_list(F.struct("run_id", "code"))).alias("r"))
    return out.select("recording", F.col("seq").cast("bigint").alias("seq"), F.transform("r", lambda x: x["code"]).alias("codes"), F.size("r").cast("bigint").alias("n_runs"))


def self_transitions(runs: DataFrame) -> Column:
    """Aggregate-ready flag: a run that repeats the code before it. A sound encoding has none."""
    return F.coalesce(F.lag("code").over(_order(["recording"], "run_id")) == F.col("code"), F.lit(False))


def prepare(runs: DataFrame, mode: str, n_states: int = 4) -> DataFrame:
    """next_state and censoring of each run, computed before abstaining runs are handled.

    ``conditioned`` drops abstaining runs and censors runs that lead into one; ``symbol`` makes abstaining a state.
    """
    nxt = F.lead("code").over(_order(["recording"], "run_id"))
    df = runs.withColumn("next_state", nxt)
    if mode == "symbol":
        as_state = lambda c: F.when(F.col(c) == ABSTAIN, n_states).otherwise(F.col(c))
        return df.withColumns({"code": as_state("code"), "next_state": as_state("next_state"), "censored": F.col("next_state").isNull()})
    if mode != "conditioned":
        raise ValueError(f"unknown mode {mode!r}")
    df = df.where(F.col("code") != ABSTAIN).withColumn("next_state", F.when(F.col("next_state") != ABSTAIN, F.col("next_state")))
    return df.withColumn("censored", F.col("next_state").isNull())


def held(frames: DataFrame, by: Sequence[str], value: str, missing: str, out: str) -> DataFrame:
    """Linear interpolation over missing frames; edge gaps hold the nearest value, all-missing series stay as they are."""
    w = _order(by)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(~F.col(missing), F.struct(F.col("t").alias("t"), F.col(value).alias("v")))
    df = frames.withColumn("_p", F.last(seen, True).over(before)).withColumn("_n", F.first(seen, True).over(after))
    p, n = F.col("_p"), F.col("_n")
    line = p["v"] + (n["v"] - p["v"]) * (F.col("t") - p["t"]) / F.when(n["t"] > p["t"], n["t"] - p["t"])
    filled = (
        F.when(~F.col(missing), F.col(value))
        .when(p.isNotNull() & n.isNotNull(), line)
        .when(p.isNotNull(), p["v"])
        .when(n.isNotNull(), n["v"])
        .otherwise(F.col(value))
    )
    return df.withColumn(out, filled).drop("_p", "_n")


def rolling_median(frames: DataFrame, by: Sequence[str], value: str, width: int, out: str) -> DataFrame:
    """Centred median over an odd width with reflected edges; series no longer than the width stay as they are.

    Reflection adds mirrored rows at both ends before the window, at most ``width`` per recording.
    """
    half = width // 2
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    df = frames.withColumn("_n", size).withColumn("_own", F.lit(True))
    mirror = lambda t, when: df.where(when & (F.col("_n") > width)).withColumns({"t": t, "_own": F.lit(False)})
    left = mirror(-F.col("t"), (F.col("t") >= 1) & (F.col("t") <= half))
    right = mirror(2 * (F.col("_n") - 1) - F.col("t"), (F.col("t") <= F.col("_n") - 2) & (F.col("t") >= F.col("_n") - 1 - half))
    w = _order(by).rowsBetween(-half, half)
    med = F.when(F.col("_n") > width, F.percentile(F.col(value), 0.5).over(w)).otherwise(F.col(value))
    return df.unionByName(left).unionByName(right).withColumn(out, med).where("_own").drop("_n", "_own")


def savgol_interior(frames: DataFrame, by: Sequence[str], value: str, width: int, out: str) -> DataFrame:
    """Second-order Savitzky-Golay smoothing where the window fits; NULL at the edges."""
    half = width // 2
    norm = (2 * half + 3) * (2 * half + 1) * (2 * half - 1) / 3.0
    weight = lambda i: (3 * half * half + 3 * half - 1 - 5 * i * i) / norm  # noqa: E731  least squares on -h..h
    w = _order(by)
    total = sum(F.lit(weight(i)) * F.lead(value, i).over(w) for i in range(-half, half + 1))
    return frames.withColumn(out, total)


def donors(frames: DataFrame, mask: str) -> DataFrame:
    """Nearest unmasked frame of each masked one, ties going backward: adds donor."""
    w = _order(["recording"])
    clean = F.when(~F.col(mask), F.col("t"))
    p = F.last(clean, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    n = F.first(clean, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    pick = F.when(p.isNull(), n).when(n.isNull(), p).when(F.col("t") - p <= n - F.col("t"), p).otherwise(n)
    return frames.withColumn("donor", F.when(F.col(mask), pick))


def envelope(runs: DataFrame, max_correct: int = 3, merge_gap: int = 5) -> DataFrame:
    """Masked islands to actions: short ones are corrected, longer ones abstain; near abstaining ones merge."""
    correct = runs.where(F.col("n_frames") <= max_correct).select("recording", F.lit("correct").alias("action"), "start", "stop")
    w = _order(["recording"], "start")
    long = runs.where(F.col("n_frames") > max_correct)
    new = F.when(F.col("start") - F.lag("stop").over(w) < merge_gap, 0).otherwise(1)
    long = long.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = long.groupBy("recording", "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return correct.unionByName(merged.select("recording", F.lit("abstain").alias("action"), "start", "stop"))


def outlier_gate(frames: DataFrame, by: Sequence[str], value: str, k: float, max_gap: int, out: str) -> DataFrame:
    """Drop jumps: steps over median + k * 1.4826 * MAD of a recording's steps, in runs up to ``max_gap`` that touch neither
    end, are interpolated. Adds ``out``."""
    w = _order(by)
    step = F.abs(F.col(value) - F.lag(value).over(w))
    df = frames.withColumn("_d", step)
    med = df.groupBy(*by).agg(F.percentile("_d", 0.5).alias("_m"))
    mad = df.join(med, list(by)).groupBy(*by, "_m").agg(F.percentile(F.abs(F.col("_d") - F.col("_m")), 0.5).alias("_s"))
    df = df.join(mad, list(by)).withColumn("_flag", F.coalesce(F.col("_d") > F.col("_m") + k * 1.4826 * F.col("_s"), F.lit(False)))
    new = F.when(F.lag("_flag").over(w).eqNullSafe(F.col("_flag")), 0).otherwise(1)
    df = df.withColumn("_g", new).withColumn("_g", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*by, "_g")
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    drop = F.col("_flag") & (F.count(F.lit(1)).over(run) <= max_gap) & (F.min("t").over(run) > 0) & (F.max("t").over(run) < size - 1)
    df = df.withColumn("_drop", drop)
    return held(df, by, value, "_drop", out).withColumnRenamed("_drop", "dropped").drop("_d", "_m", "_s", "_flag", "_g")
