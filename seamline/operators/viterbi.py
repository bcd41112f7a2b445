"""Cheapest paths over recordings of any length, by two passes over their frames in order.

The pass forwards keeps the costs of the frame before and notes for each frame where every state comes from; the pass backwards
follows these notes from the cheapest end. Costs are added frame after frame, as in SQL: added in another grouping, paths
that cost the same differ by rounding, and another one wins. What a task holds is a batch of frames, and the state of the recording that goes on in
the next batch; recordings of a batch take their steps together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a batch, at most.
BLOCK = 8192


def _lists(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _stretches(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where recordings start in a batch, and their lengths in it, longest first; a recording that goes on starts at 0."""
    starts = np.flatnonzero(np.r_[True, first[1:]])
    lengths = np.diff(np.r_[starts, len(first)])
    order = np.argsort(-lengths, kind="stable")
    return starts[order], lengths[order]


def viterbi(frames: DataFrame, n_back: int = 3, step: float = 30.0, miss: float = 8.0, block: int = BLOCK) -> DataFrame:
    """Smoothest path over each frame's own value and those of the ``n_back`` frames before: recording, t, y, replaced.

    Moves cost the square of their size in ``step``; taking another frame's value costs ``miss``. Ties go to the value of the later frame.
    """
    states, price = n_back + 1, np.array([0.0] + [miss] * n_back)
    w, back = Window.partitionBy("recording").orderBy("t"), Window.partitionBy("recording").orderBy(F.desc("t"))
    start = F.first("x").over(w.rowsBetween(Window.unboundedPreceding, 0))
    cand = F.array(*[F.coalesce(F.lag("x", b).over(w), start) if b else F.col("x") for b in range(states)])
    kind = frames.schema["recording"].dataType.simpleString()

    def forwards(batches):
        cost, before = np.zeros(states), np.zeros(states)
        for whole in batches:
            for b in (whole.slice(i, block) for i in range(0, whole.num_rows, block)):
                c, first = _lists(b.column("cand")), b.column("first").to_numpy(zero_copy_only=False)
                starts, lengths = _stretches(first)
                now, came = np.empty_like(c), np.zeros(c.shape, np.int8)
                for i in range(int(lengths[0])):
                    at = starts[: np.searchsorted(-lengths, -i)] + i  # recordings longer than i
                    was = at - 1
                    paid, seen = (now[was], c[was]) if i else (np.broadcast_to(cost, (len(at), states)), np.broadcast_to(before, (len(at), states)))
                    moves = ((c[at][:, :, None] - seen[:, None, :]) / step) ** 2 + paid[:, None, :]
                    came[at], now[at] = moves.argmin(2), moves.min(2) + price
                    fresh = at[first[at]]
                    came[fresh], now[fresh] = 0, price  # a recording's first frame has none before it
                cost, before = now[-1], c[-1]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("recording", "t", "cand")), pa.array([x.tobytes() for x in np.column_stack([came, now.argmin(1).astype(np.int8)])], pa.binary())], names=["recording", "t", "cand", "came"])

    def backwards(batches):
        into = 0
        for whole in batches:
            for b in (whole.slice(i, block) for i in range(0, whole.num_rows, block)):
                first = b.column("first").to_numpy(zero_copy_only=False)
                notes = np.frombuffer(b"".join(b.column("came").to_pylist()), np.int8).reshape(len(first), states + 1)
                came, at_end = notes[:, :states], notes[:, states]
                starts, lengths = _stretches(first)
                state = np.empty(len(first), np.int64)
                for i in range(int(lengths[0])):
                    at = starts[: np.searchsorted(-lengths, -i)] + i
                    follow = came[at - 1, state[at - 1]] if i else np.full(len(at), into)
                    state[at] = np.where(first[at], at_end[at], follow)
                into = int(came[-1, state[-1]])
                y = b.column("cand").flatten().take(pa.array(np.arange(len(first)) * states + state))
                yield pa.RecordBatch.from_arrays([b.column("recording"), b.column("t"), y, pa.array(state > 0)], names=["recording", "t", "y", "replaced"])

    def dealt(df, order, turn):
        return df.repartition("recording").sortWithinPartitions("recording", order).withColumn("first", F.row_number().over(turn) == 1)

    ready = dealt(frames.select("recording", "t", F.col("x").cast("double").alias("x")), "t", w).withColumn("cand", cand)
    went = ready.select("recording", "t", "cand", "first").mapInArrow(forwards, f"recording {kind}, t {frames.schema['t'].dataType.simpleString()}, cand array<double>, came binary")
    return dealt(went, F.desc("t"), back).mapInArrow(backwards, f"recording {kind}, t {frames.schema['t'].dataType.simpleString()}, y double, replaced boolean")
