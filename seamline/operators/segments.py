"""Change points and segments: one-sided curvature jumps, thresholds, non-maximum suppression, segment tables, mark matching."""

from __future__ import annotations

import itertools
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; only a local session may go without one and gets its own."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="seamline-"))
    return named or sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def curvature_weights(h: int) -> list[float]:
    """Weights whose sum with x(0..h) is the second derivative of the least-squares parabola through them."""
    s = np.arange(h + 1, dtype=float)
    return (2 * np.linalg.pinv(np.vander(s, 3))[0]).tolist()


def discontinuity(frames: DataFrame, channels: list[str], h: int, out: str = "d") -> DataFrame:
    """Norm over channels of right minus left curvature; zero in the first and last h frames."""
    w = Window.partitionBy("recording").orderBy("t")
    weights = curvature_weights(h)
    parts = []
    for c in channels:
        right = sum(F.lit(v) * F.lead(c, i).over(w) for i, v in enumerate(weights))
        left = sum(F.lit(v) * F.lag(c, i).over(w) for i, v in enumerate(weights))
        parts.append((right - left) ** 2)
    return frames.withColumn(out, F.coalesce(F.sqrt(sum(parts)), F.lit(0.0)))


def mad_threshold(d: DataFrame, k: float, value: str = "d") -> DataFrame:
    """Median + k * 1.4826 * MAD of each recording."""
    med = d.groupBy("recording").agg(F.percentile(value, 0.5).alias("med"))
    mad = d.join(med, "recording").groupBy("recording", "med").agg(F.percentile(F.abs(F.col(value) - F.col("med")), 0.5).alias("mad"))
    return mad.select("recording", (F.col("med") + k * 1.4826 * (F.col("mad") + 1e-12)).alias("threshold"))


def local_maxima(d: DataFrame, thresholds: DataFrame, value: str = "d") -> DataFrame:
    """Frames over their recording's threshold, at least as high as the frame before and higher than the one after."""
    w = Window.partitionBy("recording").orderBy("t")
    df = d.withColumns({"_a": F.lag(value).over(w), "_b": F.lead(value).over(w)}).join(thresholds, "recording")
    return df.where((F.col(value) > F.col("threshold")) & (F.col(value) >= F.col("_a")) & (F.col(value) > F.col("_b"))).select("recording", "t", value)


def suppress(peaks: DataFrame, gap: int, value: str = "d") -> DataFrame:
    """Tallest-first suppression within ``gap`` frames: the tallest peak left stays, what lies nearer than ``gap`` to it goes.

    Ties go to the earlier frame. Peaks ``gap`` or more apart with none between do not matter to each other, so each
    cluster of nearer ones is decided by itself, however many rounds its peaks would take.
    """
    order = Window.partitionBy("recording").orderBy("t")
    fresh = F.coalesce((F.col("t") - F.lag("t").over(order) >= gap).cast("int"), F.lit(0))
    clusters = peaks.select("recording", "t", F.col(value).alias("v"), fresh.alias("_new")).withColumn("cluster", F.sum("_new").over(order))

    def decide(batches):
        """Clusters in order, one or many to a batch; the last of a batch may go on in the next one."""
        held = None
        for batch in itertools.chain(batches, (None,)):
            if batch is not None:
                new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("recording", "cluster", "t", "v")]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if held is None or not len(held[0]):
                continue
            rec, cluster, t, v = held
            starts = np.flatnonzero(np.r_[True, (rec[1:] != rec[:-1]) | (cluster[1:] != cluster[:-1])])
            ends = np.r_[starts[1:], len(t)]
            if batch is not None:
                held = [x[starts[-1] :] for x in held]
                starts, ends = starts[:-1], ends[:-1]
            keep = np.zeros(len(t), dtype=bool)
            keep[starts[ends - starts == 1]] = True
            for lo, hi in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                own, gone = t[lo:hi], np.zeros(hi - lo, dtype=bool)
                for i in np.lexsort((own, -v[lo:hi])):
                    if not gone[i]:
                        keep[lo + i] = True
                        gone[np.searchsorted(own, own[i] - gap, side="right") : np.searchsorted(own, own[i] + gap, side="left")] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (rec, t, v)], names=["recording", "t", "v"])

    key = ["recording", "cluster"]
    dealt = clusters.select("recording", F.col("cluster").cast("long").alias("cluster"), F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v")).repartition(*key).sortWithinPartitions(*key, "t")
    kept = dealt.mapInArrow(decide, f"recording {peaks.schema['recording'].dataType.simpleString()}, t long, v double")
    return kept.select("recording", "t", F.col("v").alias(value))


def segment_table(frames: DataFrame, peaks: DataFrame, guard: int, least: int) -> DataFrame:
    """Segments between seams, abstaining edges and peaks, with abstaining share and whether they are long enough to fit."""
    w = Window.partitionBy("recording").orderBy("t")
    flagged = frames.withColumn("abstains", F.col("code") == -1)
    edge = flagged.withColumn("_e", F.coalesce(F.lag("abstains").over(w) != F.col("abstains"), F.lit(True))).where("_e").select("recording", "t")
    ends = frames.groupBy("recording").agg((F.max("t") + 1).alias("t"))
    cuts = edge.unionByName(peaks.select("recording", "t")).unionByName(ends).distinct()
    seg = cuts.select("recording", F.col("t").alias("start"), F.lead("t").over(w).alias("stop")).where("stop is not null")
    # Frames find their segment by a running count of cuts: an as-of join without a join on ranges.
    marked = flagged.join(cuts.withColumn("cut", F.lit(1)), ["recording", "t"], "left")
    marked = marked.withColumn("start", F.last(F.when(F.col("cut") == 1, F.col("t")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    share = marked.groupBy("recording", "start").agg(F.avg(F.col("abstains").cast("int")).alias("abstain_frac"), F.avg("x").alias("mean_x"))
    out = seg.join(share, ["recording", "start"]).withColumn("n_frames", F.col("stop") - F.col("start"))
    return out.withColumn("fittable", F.col("n_frames") >= least + 2 * guard)


def selectable(segments: DataFrame) -> DataFrame:
    """Long enough, free of abstaining frames and not next to a segment that has any."""
    w = Window.partitionBy("recording").orderBy("start")
    side = lambda f: F.coalesce(f("abstain_frac").over(w), F.lit(1.0)) > 0
    df = segments.withColumn("_near", side(F.lag) | side(F.lead))
    return df.where(F.col("fittable") & (F.col("abstain_frac") == 0) & ~F.col("_near")).drop("_near")


def match_marks(a: DataFrame, b: DataFrame, tol: int) -> DataFrame:
    """One-to-one pairing of two raters' marks within ``tol`` frames, nearest first: rounds of mutually best pairs.

    Candidates come from an equi-join on frame buckets of the tolerance's size, so no pair further apart is formed.
    """
    size = max(1, tol + 1)
    left = a.select("clip", F.col("frame").alias("fa"), F.explode(F.array(*[F.floor(F.col("frame") / size) + i for i in (-1, 0, 1)])).alias("_k"))
    right = b.select("clip", F.col("frame").alias("fb"), F.floor(F.col("frame") / size).alias("_k"))
    rest = left.join(right, ["clip", "_k"]).drop("_k").withColumn("d", F.abs(F.col("fa") - F.col("fb"))).where(F.col("d") <= tol)
    rest, kept = durable(rest), None
    while True:  # each round keeps the best pair that is left, so rounds end
        order = F.struct("d", "fa", "fb")
        mine = F.min(order).over(Window.partitionBy("clip", "fa"))
        theirs = F.min(order).over(Window.partitionBy("clip", "fb"))
        df = rest.withColumn("best", (mine == order) & (theirs == order))
        used = lambda k: F.bool_or("best").over(Window.partitionBy("clip", k))
        df = durable(df.withColumns({"ua": used("fa"), "ub": used("fb")}))
        now = df.where("best").select("clip", "fa", "fb", "d")
        kept = now if kept is None else kept.unionByName(now)
        rest = df.where("not ua and not ub").select("clip", "fa", "fb", "d")
        if rest.isEmpty():
            return kept


def prf(a: DataFrame, b: DataFrame, matched: DataFrame, by: str = "clip") -> DataFrame:
    """Precision, recall and F1 per clip; two empty sets agree, one empty set does not."""
    n = lambda df, c: df.groupBy(by).agg(F.count(F.lit(1)).alias(c))
    out = n(a, "n_a").join(n(b, "n_b"), by, "full").join(n(matched, "n_m"), by, "left").na.fill(0, ["n_a", "n_b", "n_m"])
    f1 = F.when((F.col("n_a") == 0) & (F.col("n_b") == 0), 1.0).otherwise(2 * F.col("n_m") / (F.col("n_a") + F.col("n_b")))
    p, r = F.try_divide(F.col("n_m"), F.col("n_b")), F.try_divide(F.col("n_m"), F.col("n_a"))
    return out.select(by, "n_a", "n_b", "n_m", F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"), f1.alias("f1"))
