"""Queries on repair: projecting suspect keypoints, and error by kind of injected corruption."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seamline.operators import geometry as g
from seamline.operators import ordered as o
from seamline.operators import resample as rs
from seamline.plans import q_geometry as qgeo
from seamline.plans import q_groupstats as qg
from seamline.sources import adapters as a

R = lambda c, n=6: F.round(c, n)
ROUNDS = 32
KINDS = (("teleport", 0.0, 0.03), ("park", 0.03, 0.06), ("noise", 0.06, 0.09))


def projection_fold(spark, sf_dir):
    """Suspect keypoints pulled into the discs that their bones' references allow around their neighbours."""
    sus = qgeo.suspects(spark, sf_dir).where("suspect >= 0").select("recording", "t", F.col("suspect").alias("k"))
    kp = a.keypoints(a.pose(spark, sf_dir)).select("recording", "t", "k", "x", "y")
    ref = qgeo.lengths(spark, sf_dir).groupBy("recording", "bone").agg((F.percentile("d", 0.9) * (1 + qgeo.EPS)).alias("r"))
    ends = [(b, i, j) for b, (i, j) in enumerate(g.BONES)] + [(b, j, i) for b, (i, j) in enumerate(g.BONES)]
    bones = F.broadcast(spark.createDataFrame(ends, "bone int, k int, other int"))
    c = sus.join(bones, "k").join(ref, ["recording", "bone"])
    c = c.join(kp.select("recording", "t", F.col("k").alias("other"), F.col("x").alias("px"), F.col("y").alias("py")), ["recording", "t", "other"])
    discs = c.groupBy("recording", "t", "k").agg(F.sort_array(F.collect_list(F.struct("px", "py", "r"))).alias("discs"))  # two bones at most
    out = g.project(discs.join(kp, ["recording", "t", "k"]), ROUNDS)
    return out.select("recording", "t", "k", R("nx", 5).alias("nx"), R("ny", 5).alias("ny"), R("moved", 5).alias("moved"))


def injection_by_kind(spark, sf_dir):
    """Injected size, error left after a five-frame median, and share removed, for each kind of corruption."""
    f = a.frames(spark, sf_dir).select("recording", "t", F.col("x").alias("truth"))
    w = Window.partitionBy("recording").orderBy("t")
    f = f.withColumns({"u": rs.draw("kinds", F.col("recording"), F.col("t")) / 2.0**32, "prev": F.coalesce(F.lag("truth", 3).over(w), F.col("truth"))})
    kind = F.when(F.lit(False), "none")
    for name, lo, hi in KINDS:
        kind = kind.when((F.col("u") >= lo) & (F.col("u") < hi), name)
    f = f.withColumn("kind", kind)
    x = F.when(F.col("kind") == "teleport", F.col("truth") + 300).when(F.col("kind") == "park", F.col("prev")).when(F.col("kind") == "noise", F.col("truth") - 40).otherwise(F.col("truth"))
    med = o.rolling_median(f.withColumn("x", x), ["recording"], "x", 5, "y").where("kind is not null")
    size, left = F.avg(F.abs(F.col("x") - F.col("truth"))), F.avg(F.abs(F.col("y") - F.col("truth")))
    return med.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), R(size).alias("injected"), R(left).alias("left_error"), R(1 - F.try_divide(left, size)).alias("removed"))


QUERIES = {f.__name__: f for f in (projection_fold, injection_by_kind)}

_ENDS = ", ".join(f"({b}, {i}, {j})" for b, i, j in [(b, i, j) for b, (i, j) in enumerate(g.BONES)] + [(b, j, i) for b, (i, j) in enumerate(g.BONES)])
_CASE = " ".join(f"WHEN u >= {lo} AND u < {hi} THEN '{n}'" for n, lo, hi in KINDS)
ORACLE = {
    "projection_fold": f"""WITH RECURSIVE {qgeo._SUSPECT}, en AS (SELECT * FROM (VALUES {_ENDS}) e(bone, k, other)),
rr AS (SELECT recording, bone, quantile_cont(d, 0.9) * {1 + qgeo.EPS} AS r FROM len GROUP BY ALL),
dc AS (SELECT s.recording, s.t, s.suspect AS k, list({{px: o.x, py: o.y, r: rr.r}}) AS discs FROM sus s JOIN en ON en.k = s.suspect JOIN rr ON rr.recording = s.recording AND rr.bone = en.bone JOIN kp o ON o.recording = s.recording AND o.t = s.t AND o.k = en.other WHERE suspect >= 0 GROUP BY ALL),
go(recording, t, k, step, x, y, discs) AS (SELECT dc.recording, dc.t, dc.k, 0, kp.x, kp.y, discs FROM dc JOIN kp ON kp.recording = dc.recording AND kp.t = dc.t AND kp.k = dc.k
  UNION ALL SELECT recording, t, k, step + 1, CASE WHEN w.e > 1e-9 THEN w.px + (x - w.px) * w.r / greatest(w.e + w.r, 1e-12) ELSE x END, CASE WHEN w.e > 1e-9 THEN w.py + (y - w.py) * w.r / greatest(w.e + w.r, 1e-12) ELSE y END, discs
  FROM (SELECT *, list_max(list_transform(discs, lambda c: {{e: sqrt((x - c.px)**2 + (y - c.py)**2) - c.r, px: c.px, py: c.py, r: c.r}})) AS w FROM go WHERE step < {ROUNDS}) z)
SELECT go.recording, go.t, go.k, round(go.x, 5) AS nx, round(go.y, 5) AS ny, round(sqrt((go.x - kp.x)**2 + (go.y - kp.y)**2), 5) AS moved FROM go JOIN kp ON kp.recording = go.recording AND kp.t = go.t AND kp.k = go.k WHERE step = {ROUNDS}""",
    "injection_by_kind": f"""WITH {a.FRAMES_SQL}, u AS (SELECT recording, t, x AS truth, {qg._draw("'kinds'", "recording", "t")} / 4294967296.0 AS u, coalesce(lag(x, 3) OVER (PARTITION BY recording ORDER BY t), x) AS prev FROM frames),
k AS (SELECT *, CASE {_CASE} END AS kind FROM u), f AS (SELECT recording, t, truth, kind, CASE kind WHEN 'teleport' THEN truth + 300 WHEN 'park' THEN prev WHEN 'noise' THEN truth - 40 ELSE truth END AS x, count(*) OVER (PARTITION BY recording) AS n FROM k),
m AS (SELECT *, true AS own FROM f UNION ALL SELECT recording, -t, truth, kind, x, n, false FROM f WHERE n > 5 AND t BETWEEN 1 AND 2 UNION ALL SELECT recording, 2 * (n - 1) - t, truth, kind, x, n, false FROM f WHERE n > 5 AND t BETWEEN n - 3 AND n - 2),
w AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY recording ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mm FROM m), y AS (SELECT kind, abs(x - truth) AS s, abs(CASE WHEN n > 5 THEN mm ELSE x END - truth) AS e FROM w WHERE own AND kind IS NOT NULL)
SELECT kind, count(*) AS n, round(avg(s), 6) AS injected, round(avg(e), 6) AS left_error, round(1 - avg(e) / avg(s), 6) AS removed FROM y GROUP BY kind""",
}
