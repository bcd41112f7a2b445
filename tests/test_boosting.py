"""Boosted trees: the distributed histograms give what one loop over all rows gives."""

import numpy as np
import pytest

from seamline.operators import boosting


def data(n=600):
    pick = np.random.default_rng(0)
    x = np.round(pick.normal(size=(n, 3)) * [1, 5, 100], 3)
    y = (x[:, 0] > 0.3) * 2.0 - (x[:, 1] > 2) * (x[:, 2] < 10) * 1.5 + np.round(pick.normal(size=n) * 0.1, 3)
    return x, y, np.arange(n) % 3


def one_tree(b, y, now, shape, logistic):
    """A tree by looking at all rows for every split."""
    node, leaves = np.zeros(len(y), int), np.zeros(len(y))
    p = 1 / (1 + np.exp(-now))
    g = np.rint((p - y if logistic else now - y) * boosting.UNIT) / boosting.UNIT
    h = np.rint((p * (1 - p) if logistic else np.ones(len(y))) * boosting.UNIT) / boosting.UNIT
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + shape.least)
    for level in range(shape.depth):
        new = node.copy()
        for k in np.unique(node):
            own, best = node == k, (1e-9, None)
            for f in range(b.shape[1]):
                for c in range(shape.bins - 1):
                    left, right = own & (b[:, f] <= c), own & (b[:, f] > c)
                    if left.any() and right.any() and (gain := part(left) + part(right) - part(own)) > best[0] + 1e-9:
                        best = gain, right
            if best[1] is not None:
                new[best[1]] += 1 << level
        node = new
    for k in np.unique(node):
        own = node == k
        leaves[own] = -shape.rate * g[own].sum() / (h[own].sum() + shape.least)
    return leaves


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_same_as_a_plain_loop(spark, loss):
    x, y, fold = data()
    y = (y > 0.5).astype(float) if loss == "logistic" else y
    shape = boosting.Shape(loss=loss, trees=3, depth=2, bins=8)
    df = spark.createDataFrame([(*map(float, r), float(t), int(k)) for r, t, k in zip(x, y, fold, strict=True)], "a double, b double, c double, y double, k int").repartition(5)
    made = boosting.fit(df, ["a", "b", "c"], "y", "k", 3, shape)
    bins = made.bins_of(x)
    assert all(len(e) == 7 for e in made.edges) and all(np.bincount(bins[:, f]).min() > 40 for f in range(3))
    for m in range(3):
        own = fold != m
        now = np.full(own.sum(), made.start[m])
        for _ in range(3):
            now = now + one_tree(bins[own], y[own], now, shape, loss == "logistic")
        assert np.allclose(now, made.predict(x[own], m), atol=1e-6)


def test_learns_and_does_not_see_the_held_out_fold(spark):
    x, y, fold = data(3000)
    df = spark.createDataFrame([(*map(float, r), float(t), int(k)) for r, t, k in zip(x, y, fold, strict=True)], "a double, b double, c double, y double, k int")
    made = boosting.fit(df, ["a", "b", "c"], "y", "k", 3)
    for m in range(3):
        out = fold == m
        assert 1 - np.var(y[out] - made.predict(x[out], m)) / np.var(y[out]) > 0.95
    other = boosting.fit(df.withColumn("y", df.y + (df.k == 0).cast("int") * 100).repartition(3), ["a", "b", "c"], "y", "k", 3)
    assert np.array_equal(other.predict(x, 0), made.predict(x, 0))


def test_nulls_constants_and_no_rows(spark):
    df = spark.createDataFrame([(None, float("nan"), 1.0), (1.0, 2.0, 3.0), (5.0, float("inf"), None)], "a double, b double, y double")
    assert np.isfinite(boosting.fit(df, ["a", "b"], "y").predict([[0, 0], [np.nan, 1]])).all()
    assert boosting.fit(df.where("y = 3"), ["a"], "y").predict([[7.0]])[0] == 3
    assert boosting.fit(df.where("false"), ["a"], "y").predict([[7.0]])[0] == 0


def test_every_row_is_scored_by_the_model_without_its_fold(spark):
    x, y, fold = data(900)
    df = spark.createDataFrame([(*map(float, r), float(t), int(k)) for r, t, k in zip(x, y, fold, strict=True)], "a double, b double, c double, y double, k int")
    made = boosting.fit(df, ["a", "b", "c"], "y", "k", 3)
    got = sorted(map(tuple, boosting.held_out(df.repartition(4), made, "y", "k").collect()))
    want = sorted((int(k), float(t), float(made.predict(r[None], k)[0])) for r, t, k in zip(x, y, fold, strict=True))
    assert np.allclose(got, want)
    for r in boosting.explained(boosting.held_out(df, made, "y", "k")).collect():
        own = np.array([(t, p) for k, t, p in want if k == r.fold])
        assert r.n == 300 and r.r2 == pytest.approx(1 - ((own[:, 0] - own[:, 1]) ** 2).sum() / ((own[:, 0] - own[:, 0].mean()) ** 2).sum())
