"""Partitions, assignment and distortion, mixtures, probes, sequences as signals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.operators.groupstats import quantiles
from seamline.operators.viterbi import viterbi  # noqa: F401  it began here, and callers may still look for it here


def assign(bank: DataFrame, centroids: DataFrame, by: str = "vec") -> DataFrame:
    """Nearest centroid (lowest id on ties): adds code and sq_error. Centroids are as many as states, and broadcast."""
    c = F.broadcast(centroids.agg(F.sort_array(F.collect_list(F.struct(F.col("state"), F.col("centre")))).alias("cs")))
    sq = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("cs", lambda k: F.struct(sq(F.col(by), k["centre"]).alias("d"), k["state"].alias("state"))))
    out = bank.crossJoin(c).withColumn("_b", best)  # one row of centroids
    return out.select(*bank.columns, F.col("_b.state").alias("code"), F.col("_b.d").alias("sq_error"))


def fit_kmeans(bank: DataFrame, n_states: int, seed: int = 0, by: str = "vec") -> DataFrame:
    """Centroids (state, centre) of a k-means partition."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=n_states, seed=seed, featuresCol="_f").fit(bank.select(array_to_vector(by).alias("_f")))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return bank.sparkSession.createDataFrame(rows, "state int, centre array<double>")


def pca_variance(bank: DataFrame, k: int, by: str = "vec") -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(bank.select(array_to_vector(by).alias("_f")))
    rows = [(i, float(v)) for i, v in enumerate(model.explainedVariance)]
    return bank.sparkSession.createDataFrame(rows, "axis int, share double")


def probe(df: DataFrame, features: list[str], label: str, group: str, folds: int = 3) -> DataFrame:
    """Balanced accuracy of a logistic probe, held out by group: (fold, n, balanced_accuracy)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="_f").transform(df.withColumn("_y", F.col(label).cast("double")))
    data = data.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")).select("_f", "_y", "fold").persist()
    out = None
    for k in range(folds):
        train = data.where(F.col("fold") != k)
        n = {r["_y"]: r["count"] for r in train.groupBy("_y").count().collect()}  # two classes
        if len(n) < 2:
            continue
        weight = F.when(F.col("_y") == 1, 0.5 / n[1.0]).otherwise(0.5 / n[0.0]) * sum(n.values())
        model = LogisticRegression(featuresCol="_f", labelCol="_y", weightCol="_w", maxIter=50).fit(train.withColumn("_w", weight))
        got = model.transform(data.where(F.col("fold") == k)).groupBy("_y").agg(F.avg((F.col("prediction") == F.col("_y")).cast("int")).alias("r"), F.count(F.lit(1)).alias("n"))
        part = got.agg(F.lit(k).alias("fold"), F.sum("n").alias("n"), F.avg("r").alias("balanced_accuracy"))
        out = part if out is None else out.unionByName(part)
    return out


def mixture_bic_gain(df: DataFrame, value: str, rounds: int = 30) -> DataFrame:
    """BIC of one Gaussian less BIC of two, by EM from the quartiles; the driver holds six numbers between rounds."""
    x = F.col(value)
    q = df.agg(F.var_pop(x).alias("v"), F.avg(x).alias("m"), F.count(x).alias("n")).first()
    if not q.n or not q.v:
        return df.sparkSession.createDataFrame([(0.0, 0)], "bic_gain double, n long").limit(0)
    mu, var, pi = quantiles(df, value, [0.25, 0.75]), [q.v, q.v], [0.5, 0.5]
    pdf = lambda k: F.lit(pi[k] / math.sqrt(2 * math.pi * var[k])) * F.exp(-((x - mu[k]) ** 2) / (2 * var[k]))
    fit = 0.0
    for _ in range(rounds):
        p0, p1 = pdf(0), pdf(1)
        r = p0 / F.greatest(p0 + p1, F.lit(1e-300))
        s = df.agg(F.sum(r), F.sum(r * x), F.sum(r * x * x), F.sum(1 - r), F.sum((1 - r) * x), F.sum((1 - r) * x * x), F.sum(F.log(F.greatest(p0 + p1, F.lit(1e-300))))).first()
        fit = s[6]
        for k in (0, 1):
            w = max(s[3 * k], 1e-9)
            mu[k] = s[3 * k + 1] / w
            var[k] = max(s[3 * k + 2] / w - mu[k] ** 2, 1e-9)
            pi[k] = w / q.n
    one = -2 * (-0.5 * q.n * (math.log(2 * math.pi * q.v) + 1)) + 2 * math.log(q.n)
    two = -2 * fit + 5 * math.log(q.n)
    return df.sparkSession.createDataFrame([(one - two, q.n)], "bic_gain double, n long")


def _grouped(frames: DataFrame, fn, schema: str) -> DataFrame:
    """One task per recording; a recording's rows are one sequence, which these operators need whole and in order."""
    return frames.groupBy("recording").applyInPandas(lambda pdf: fn(pdf.sort_values("t")), schema)


def surrogate(frames: DataFrame, kind: str, seed: int = 11, order: int = 5) -> DataFrame:
    """A structureless stand-in for each recording: white, ou, phase or var. Seeds follow the recording, not the task."""
    if kind not in ("white", "ou", "phase", "var"):
        raise ValueError(f"unknown surrogate {kind!r}")

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["x"].to_numpy(float)
        n = len(x)
        rng = np.random.Generator(np.random.PCG64([seed, int(pdf["recording"].iloc[0])]))
        if n < 4:
            y = x
        elif kind == "white":
            y = rng.normal(x.mean(), x.std(), n)
        elif kind == "ou":
            c = float(np.clip(np.corrcoef(x[:-1], x[1:])[0, 1], -0.99, 0.99)) if x.std() > 0 else 0.0
            e = rng.standard_normal(n)
            y = np.empty(n)
            y[0] = e[0]
            for i in range(1, n):
                y[i] = c * y[i - 1] + math.sqrt(1 - c * c) * e[i]
            y = x.mean() + x.std() * y
        elif kind == "phase" or n < 3 * order:
            f = np.fft.rfft(x)
            turn = np.exp(2j * np.pi * rng.random(len(f)))
            turn[0] = 1
            if n % 2 == 0:
                turn[-1] = 1
            y = np.fft.irfft(f * turn, n)
        else:
            lags = np.stack([x[order - i - 1 : n - i - 1] for i in range(order)] + [np.ones(n - order)], axis=1)
            coef = np.linalg.lstsq(lags, x[order:], rcond=None)[0]
            noise = rng.permutation(x[order:] - lags @ coef)
            y = x.copy()
            for i in range(order, n):
                y[i] = coef[:-1] @ y[i - order : i][::-1] + coef[-1] + noise[i - order]
            if not np.isfinite(y).all():
                y = x
        return pd.DataFrame({"recording": pdf["recording"].to_numpy(), "t": pdf["t"].to_numpy(), "y": y})

    return _grouped(frames.select("recording", "t", "x"), make, "recording long, t long, y double")


def resample(frames: DataFrame, n: int) -> DataFrame:
    """Each recording's signal at ``n`` points of equal spacing, ends kept: (recording, i, y)."""
    s = frames.groupBy("recording").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda z: z["x"]).alias("v"))
    last = F.size("v") - 1
    pos = lambda i: i * last / (n - 1)
    at = lambda i: F.least(F.floor(pos(i)).cast("int"), F.greatest(last - 1, F.lit(0)))
    lo, hi = lambda i: F.get("v", at(i)), lambda i: F.get("v", F.least(at(i) + 1, last))
    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo(i) + (hi(i) - lo(i)) * (pos(i) - at(i)))
    return s.select("recording", F.posexplode(grid).alias("i", "y"))


def retention(frames: DataFrame, before: str, after: str, low: int) -> DataFrame:
    """Power after over power before, under and from frequency index ``low`` on, of mean-free series; by a transform per recording."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = {c: np.abs(np.fft.rfft(pdf[c].to_numpy(float) - pdf[c].mean())) ** 2 for c in (before, after)}
        ratio = lambda s: float(p[after][s].sum() / p[before][s].sum()) if len(p[before][s]) and p[before][s].sum() > 0 else float("nan")
        return pd.DataFrame({"recording": [pdf["recording"].iloc[0]], "n": [len(pdf)], "low": [ratio(slice(1, low))], "high": [ratio(slice(low, None))]})

    out = _grouped(frames.select("recording", "t", before, after), run, "recording long, n long, low double, high double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("low", "high")})
