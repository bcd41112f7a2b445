"""Gradient-boosted trees from histograms that Spark adds up.

A row's features become bins once. Every level of every tree is one aggregation: tasks add the gradients of their rows by
(model, node, feature, bin), the sums over tasks come to the driver, as many numbers as the trees' shape asks for and no
row, and the best split of each node follows. Gradients are rounded to whole units before they are added, so sums, and with
them the trees, do not depend on the order of rows or partitions. Several models, each without one fold of groups, grow in
the same passes.

Defined cases: a null or non-finite feature is 0; rows without a target are left out; without rows, or with one value of the
target, the model is a constant; ties of splits go to the lowest feature and bin.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.operators.segments import durable

#: Units per 1.0 of a gradient.
UNIT = 1 << 20
#: Cells of the grid that bin edges are chosen from; the grid is even in the logarithm of 1 + |value|.
GRID = 1024


@dataclass
class Shape:
    loss: str = "squared"  # or "logistic", for targets 0 and 1
    trees: int = 20
    depth: int = 3
    bins: int = 32
    rate: float = 0.3
    least: float = 1.0  # weight of the penalty on leaf values


@dataclass
class Boosted:
    """Edges per feature; per model a start and trees of (feature, bin, value) arrays, nodes in breadth-first order."""

    features: Sequence[str]
    shape: Shape
    edges: list[np.ndarray]
    start: list[float]
    trees: list[list[tuple]] = field(default_factory=list)

    def bins_of(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) values to bins."""
        x = np.nan_to_num(np.asarray(x, float), nan=0.0, posinf=0.0, neginf=0.0)
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1).astype(np.uint8) if len(self.edges) else np.zeros((len(x), 0), np.uint8)

    def leaves(self, b: np.ndarray, tree: tuple, depth: int) -> np.ndarray:
        feature, cut, _ = tree
        node, rows = np.zeros(len(b), int), np.arange(len(b))
        for _ in range(depth):
            right = b[rows, feature[node]] > cut[node]
            node = 2 * node + 1 + right
        return node

    def margin(self, b: np.ndarray, model: int = 0) -> np.ndarray:
        out, inner = np.full(len(b), self.start[model]), 2**self.shape.depth - 1
        for tree in self.trees[model]:
            out += tree[2][self.leaves(b, tree, self.shape.depth) - inner]
        return out

    def predict(self, x: np.ndarray, model: int = 0) -> np.ndarray:
        """Predicted values, or log-odds if the loss is logistic."""
        return self.margin(self.bins_of(x), model)


def _flat(x):
    return np.sign(x) * np.log1p(np.abs(x))


def _matrix(batch, features: int) -> np.ndarray:
    """The first columns of a batch as a matrix; nulls and what is not finite are 0."""
    x = np.stack([batch.column(i).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for i in range(features)], 1)
    return np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)


def _summed(df: DataFrame, fn) -> dict[int, tuple]:
    """Sums over tasks of what ``fn`` gives for a batch: {slot: (a, b)} of whole numbers; the driver sees a row per slot."""

    def run(batches):
        held = None
        for b in batches:
            if b.num_rows:
                now = fn(b)
                held = now if held is None else held + now
        if held is not None:
            at = np.flatnonzero(held.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at, 0]), pa.array(held[at, 1])], names=["slot", "a", "b"])

    rows = df.mapInArrow(run, "slot long, a long, b long").groupBy("slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return {r["slot"]: (r["a"], r["b"]) for r in rows.collect()}


def _edges(data: DataFrame, n: int, bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 edges a feature, at even shares of the rows as far as the grid can tell."""
    cols = data.columns[:n]
    flat = lambda c: F.signum(c) * F.log1p(F.abs(c))
    ends = data.agg(*[f(flat(F.col(c))).alias(f"{f.__name__}{i}") for i, c in enumerate(cols) for f in (F.min, F.max)]).first()
    low = np.array([ends[f"min{i}"] or 0.0 for i in range(n)])
    step = np.array([((ends[f"max{i}"] or 0.0) - low[i]) / GRID or 1.0 for i in range(n)])

    def count(batch):
        cell = np.clip(((_flat(_matrix(batch, n)) - low) / step).astype(int), 0, GRID - 1) + GRID * np.arange(n)
        ones = np.bincount(cell.ravel(), minlength=GRID * n)
        return np.stack([ones, ones], 1)

    found, out = _summed(data, count), []
    for f in range(n):
        upto = np.cumsum([found.get(f * GRID + c, (0, 0))[0] for c in range(GRID)])
        if not upto[-1]:
            out.append(np.zeros(0))
            continue
        # An edge closes the cell in which a share of the rows is reached; the last cell needs none.
        cells = sorted({int(np.searchsorted(upto, upto[-1] * k / bins)) for k in range(1, bins)} - {GRID - 1})
        at = low[f] + (np.array(cells, float) + 1) * step[f]
        out.append(np.sign(at) * np.expm1(np.abs(at)))
    return out


def fit(df: DataFrame, features: Sequence[str], target: str, fold: str | None = None, folds: int = 1, shape: Shape = Shape()) -> Boosted:  # noqa: B008
    """Trees for a numeric target; with ``fold`` (0 to ``folds`` - 1), model k learns from all rows but those of fold k."""
    n, models = len(features), folds if fold else 1
    plain = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]
    data = df.where(F.col(target).isNotNull()).select(*plain, F.col(target).cast("double").alias("y"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"))
    data = durable(data)
    made = Boosted(list(features), shape, _edges(data, n, shape.bins), [0.0] * models, [[] for _ in range(models)])

    def binned(batches):
        for b in batches:
            bins = made.bins_of(_matrix(b, n))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), b.column(n), b.column(n + 1)], names=["bins", "y", "fold"])

    rows = durable(data.mapInArrow(binned, "bins binary, y double, fold int"))
    sums = {r["fold"]: (r["n"], r["y"]) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("y") * UNIT).cast("long")).alias("y")).collect()}
    for m in range(models):
        count, total = (sum(v[i] for k, v in sums.items() if k != m or not fold) for i in (0, 1))
        mean = total / UNIT / count if count else 0.0
        made.start[m] = float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6))) if shape.loss == "logistic" and count else mean
    if n and rows.agg(F.min("y") < F.max("y")).first()[0]:
        for _ in range(shape.trees):
            _grow(made, rows, bool(fold))
    return made


def _grow(made: Boosted, rows: DataFrame, folded: bool) -> None:
    """One more tree for every model, level by level."""
    s, n, models = made.shape, len(made.features), len(made.start)
    inner, width = 2**s.depth - 1, s.bins
    trees = [(np.zeros(inner, int), np.full(inner, 255), np.zeros(inner + 1)) for _ in range(models)]
    for level in range(s.depth):
        first, nodes = 2**level - 1, 2**level

        def gradients(batch, level=level, first=first, nodes=nodes):
            b = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, n)
            y, of = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            out = np.zeros((models * nodes * n * width, 2), np.int64)
            for m in range(models):
                own = of != m if folded else slice(None)
                bm, ym = b[own], y[own]
                now = made.margin(bm, m)
                if s.loss == "logistic":
                    p = 1 / (1 + np.exp(-now))
                    g, h = p - ym, p * (1 - p)
                else:
                    g, h = now - ym, np.ones(len(ym))
                node = made.leaves(bm, trees[m], level) - first
                slot = (((m * nodes + node) * n)[:, None] + np.arange(n)) * width + bm
                for i, v in enumerate((g, h)):
                    whole = np.broadcast_to(np.rint(v * UNIT)[:, None], slot.shape)
                    out[:, i] += np.bincount(slot.ravel(), whole.ravel(), len(out)).astype(np.int64)
            return out

        found = _summed(rows, gradients)
        table = np.zeros((models * nodes * n * width, 2))
        for slot, v in found.items():
            table[slot] = v
        table = table.reshape(models, nodes, n, width, 2) / UNIT
        for m in range(models):
            for k in range(nodes):
                left = table[m, k].cumsum(1)[:, :-1]
                total = table[m, k, 0].sum(0)
                right = total - left
                score = lambda v: v[..., 0] ** 2 / (v[..., 1] + s.least)
                gain = score(left) + score(right) - score(total)
                gain[(left[..., 1] <= 0) | (right[..., 1] <= 0)] = 0
                f, c = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else (0, 0)
                at = first + k
                if gain.size and gain[f, c] > 1e-9:
                    trees[m][0][at], trees[m][1][at] = f, c
                    ends = left[f, c], right[f, c]
                else:  # all rows go left
                    ends = total, np.zeros(2)
                if level == s.depth - 1:
                    for side, v in enumerate(ends):
                        trees[m][2][2 * at + 1 + side - inner] = -s.rate * v[0] / (v[1] + s.least)
    for m in range(models):
        made.trees[m].append(trees[m])


def held_out(df: DataFrame, made: Boosted, target: str, fold: str) -> DataFrame:
    """(fold, y, predicted): every row with a target, by the model that did not learn from its fold."""
    n = len(made.features)
    plain = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(made.features)]
    rows = df.where(F.col(target).isNotNull()).select(*plain, F.col(target).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"))

    def run(batches):
        for b in batches:
            bins, of = made.bins_of(_matrix(b, n)), b.column(n + 1).to_numpy(zero_copy_only=False)
            out = np.zeros(len(of))
            for m in np.unique(of):
                out[of == m] = made.margin(bins[of == m], int(m))
            yield pa.RecordBatch.from_arrays([b.column(n + 1), b.column(n), pa.array(out)], names=["fold", "y", "predicted"])

    return rows.mapInArrow(run, "fold int, y double, predicted double")


def explained(scored: DataFrame) -> DataFrame:
    """(fold, n, r2): share of the target's variance in a fold that the model without the fold explains; none without variance."""
    off, y = F.col("y") - F.col("predicted"), F.col("y")
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), (1 - F.try_divide(F.sum(off * off), F.var_pop(y) * F.count(F.lit(1)))).alias("r2"))
