"""Chance agreement of marks: what raters who scatter as many marks at random over the same clip would reach.

A replicate of a clip is drawn and matched inside one task, so scattered marks are neither moved nor kept: what leaves a task is
a count of matched marks per clip and stretch of replicates.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Replicates of a clip that one row stands for; draws that a task holds at once (one replicate of one clip at least).
STRETCH = 8
DRAWS = 1 << 18


def _drawn(seed: int, who: str, clip: list[str], rep: np.ndarray, k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, frame): for each unit, a replicate of a clip, k distinct frames under n by Floyd's method; numbers as of ``resample.draw``."""
    tails = [b"%d" % i for i in range(int(k.max(initial=0)))]
    heads = [f"{seed}|{who}|{c}|{r}|".encode() for c, r in zip(clip, rep.tolist(), strict=True)]
    u = np.frombuffer(b"".join([md5(head + tail).digest()[:4] for head, m in zip(heads, k.tolist(), strict=True) for tail in tails[:m]]), ">u4") / 2.0**32
    unit, ends = np.repeat(np.arange(len(k)), k), np.cumsum(k)
    last = np.repeat(n - k, k) + np.arange(len(unit)) - np.repeat(ends - k, k)
    frame = np.floor(u * (last + 1)).astype(np.int64)
    order = np.lexsort((frame, unit))
    again = (unit[order][1:] == unit[order][:-1]) & (frame[order][1:] == frame[order][:-1])
    for x in np.unique(unit[order][1:][again]).tolist():  # only where a number came twice does its order matter
        seen: set[int] = set()
        for p in range(int(ends[x] - k[x]), int(ends[x])):
            if int(frame[p]) in seen:
                frame[p] = last[p]
            seen.add(int(frame[p]))
    return unit, frame


def _matched(a: np.ndarray, b: np.ndarray, tol: int) -> np.ndarray:
    """Places in a (as b sorted and without repeats) that are matched, nearest first: rounds of mutually best pairs within ``tol``."""
    low = np.searchsorted(b, a - tol)
    many = np.searchsorted(b, a + tol, "right") - low
    x = np.repeat(np.arange(len(a)), many)
    y = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    order = np.lexsort((y, x, np.abs(a[x] - b[y])))
    x, y, kept = x[order], y[order], []
    best_x, best_y, used_x, used_y = np.empty(len(a), np.int64), np.empty(len(b), np.int64), np.zeros(len(a), bool), np.zeros(len(b), bool)
    while len(x):
        place = np.arange(len(x))
        best_x[x[::-1]], best_y[y[::-1]] = place[::-1], place[::-1]
        best = (best_x[x] == place) & (best_y[y] == place)
        kept.append(x[best])
        used_x[x[best]], used_y[y[best]] = True, True
        rest = ~used_x[x] & ~used_y[y]
        x, y = x[rest], y[rest]
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def _stretches(clips: DataFrame, counts: list[str], restarts: int) -> DataFrame:
    """Clips by stretches of their replicates, dealt over tasks: clip, text (its name in draws), n_frames, first, and each count up to n_frames."""
    most = [F.least(F.col(c), F.col("n_frames")).cast("long").alias(c) for c in counts]
    rows = clips.select("clip", F.col("clip").cast("string").alias("text"), F.col("n_frames").cast("long").alias("n_frames"), *most)
    rows = rows.where(" and ".join(f"{c} > 0" for c in counts)).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1), F.lit(STRETCH))))
    return rows.repartition(4 * int(clips.sparkSession.conf.get("spark.sql.shuffle.partitions")), "clip", "first")


def _units(batch: pa.RecordBatch, counts: list[str], restarts: int, room: int):
    """Units of a batch in chunks: (rows, replicates, names, n_frames, counts), some ``DRAWS`` draws each."""
    first, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "n_frames"))
    k = [batch.column(c).to_numpy(zero_copy_only=False) for c in counts]
    each = np.minimum(STRETCH, restarts - first)
    row = np.repeat(np.arange(len(first)), each)
    rep = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    text, upto, lo = batch.column("text").to_pylist(), np.cumsum(sum(k)[row]), 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + DRAWS, "right")))
        hi = min(hi, lo + max(1, 2**62 // (int(n.max()) + room)))  # units side by side on one line of frames
        at = row[lo:hi]
        yield at, rep[lo:hi], [text[i] for i in at.tolist()], n[at], [c[at] for c in k]
        lo = hi


def scattered(clips: DataFrame, count: str, who: str, restarts: int, seed: int) -> DataFrame:
    """(clip, rep, frame): ``restarts`` draws of ``count`` distinct frames of each clip's n_frames, every set as likely."""

    def run(batches):
        for batch in batches:
            for at, rep, text, n, (k,) in _units(batch, [count], restarts, 0):
                unit, frame = _drawn(seed, who, text, rep, k, n)
                yield pa.RecordBatch.from_arrays([batch.column("clip").take(pa.array(at[unit])), pa.array(rep[unit].astype(np.int32)), pa.array(frame)], names=["clip", "rep", "frame"])

    kind = clips.schema["clip"].dataType.simpleString()
    return _stretches(clips, [count], restarts).mapInArrow(run, f"clip {kind}, rep int, frame long")


def chance_f1(clips: DataFrame, tol: int, restarts: int = 200, seed: int = 0) -> DataFrame:
    """(clip, chance_f1) of clips (clip, n_a, n_b, n_frames).

    All replicates of all clips are matched in one plan. Two empty sets agree, one empty set and a clip without frames do not.
    """

    def run(batches):
        for batch in batches:
            met = np.zeros(batch.num_rows, np.int64)
            for at, rep, text, n, k in _units(batch, ["n_a", "n_b"], restarts, tol + 1):
                room, sides = int(n.max()) + tol + 1, []
                for who, many in zip(("n_a", "n_b"), k, strict=True):
                    unit, frame = _drawn(seed, who, text, rep, many, n)
                    sides.append(np.sort(unit * room + frame))
                met += np.bincount(at[sides[0][_matched(*sides, tol)] // room], minlength=len(met))
            yield pa.RecordBatch.from_arrays([batch.column("clip"), pa.array(met)], names=["clip", "met"])

    kind = clips.schema["clip"].dataType.simpleString()
    met = _stretches(clips, ["n_a", "n_b"], restarts).mapInArrow(run, f"clip {kind}, met long").groupBy("clip").agg(F.sum("met").alias("_met"))
    both = F.least("n_a", "n_frames") + F.least("n_b", "n_frames")
    none = (F.col("n_a") == 0) & (F.col("n_b") == 0)
    one = ((F.col("n_a") == 0) != (F.col("n_b") == 0)) | (F.col("n_frames") <= 0)
    f1 = F.try_divide(2.0 * F.coalesce("_met", F.lit(0)), both) / restarts
    return clips.join(met, "clip", "left").select("clip", F.when(none, 1.0).when(one, 0.0).otherwise(f1).alias("chance_f1"))
