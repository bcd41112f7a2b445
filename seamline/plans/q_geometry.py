"""Queries on keypoint geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.operators import geometry as g
from seamline.sources import adapters as a

EPS = 0.1
R = lambda c, n=6: F.round(c, n)


def lengths(spark, sf_dir, pairs=g.BONES):
    return g.bone_lengths(a.pose(spark, sf_dir), pairs)


def bone_lengths(spark, sf_dir):
    return lengths(spark, sf_dir).select("recording", "t", "bone", R("d").alias("d"))


def rigid_pairs(spark, sf_dir):
    return g.rigid_pairs(lengths(spark, sf_dir, g.all_pairs(7))).select("recording", "bone", R("mad").alias("mad"))


def reference_length(spark, sf_dir):
    return g.reference_length(lengths(spark, sf_dir), EPS).select("recording", "bone", R("l_hat").alias("l_hat"))


def _viol(spark, sf_dir):
    d = lengths(spark, sf_dir)
    top = d.groupBy("recording", "bone").agg((F.percentile("d", 0.9)).alias("l_hat"))
    return g.violations(d, top, EPS)


def violations_mask(spark, sf_dir):
    return _viol(spark, sf_dir).groupBy("recording", "t").agg(F.bool_or("viol").alias("violated"), F.sum(F.col("viol").cast("bigint")).alias("n_bones"))


def attribution(spark, sf_dir):
    return g.attribution(_viol(spark, sf_dir)).select("k", "frames", R("share").alias("share"))


def overlap_2x2(spark, sf_dir):
    v = violations_mask(spark, sf_dir)
    m = a.keypoints(a.pose(spark, sf_dir)).groupBy("recording", "t").agg(F.bool_or("missing").alias("missing"))
    both = v.join(m, ["recording", "t"])
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    x, y = F.col("violated"), F.col("missing")
    out = both.groupBy("recording").agg(n(x & y).alias("both"), n(x & ~y).alias("only_viol"), n(~x & y).alias("only_missing"), n(~x & ~y).alias("neither"))
    return out.withColumn("jaccard", R(F.try_divide(F.col("both"), F.col("both") + F.col("only_viol") + F.col("only_missing"))))


def body_length_by_recording(spark, sf_dir):
    p = a.pose(spark, sf_dir)
    return p.groupBy("recording").agg(R(F.percentile(g.distance(F.get("pose", g.NOSE), F.get("pose", g.TAIL)), 0.5)).alias("ell"))


def egocentric(spark, sf_dir):
    out = g.egocentric(a.pose(spark, sf_dir), F.lit(0.5)).select("recording", "t", F.posexplode("ego").alias("k", "p"))
    return out.select("recording", "t", "k", R("p.x").alias("x"), R("p.y").alias("y"))


def twist_se2(spark, sf_dir):
    out = g.twist(a.pose(spark, sf_dir), F.lit(0.5))
    return out.select("recording", "t", R("v_x", 5).alias("v_x"), R("v_y", 5).alias("v_y"), R("omega", 5).alias("omega"))


def continuity_spike_step(spark, sf_dir):
    return g.spike_step(a.pose(spark, sf_dir)).select("recording", "t", "k", R("spike").alias("spike"), R("step").alias("step"))


def suspects(spark, sf_dir):
    return g.suspects(_viol(spark, sf_dir), a.pose(spark, sf_dir))


def reliability(spark, sf_dir):
    """Confidence in [0, 1], halved for suspects and 0 where a frame has violations without a common keypoint."""
    kp = a.keypoints(a.pose(spark, sf_dir)).join(suspects(spark, sf_dir).select("recording", "t", "suspect"), ["recording", "t"], "left")
    c = F.greatest(F.least("conf", F.lit(1.0)), F.lit(0.0))
    out = F.when(F.col("suspect") == -1, 0.0).when(F.col("suspect") == F.col("k"), c * 0.5).otherwise(c)
    return kp.groupBy("recording", "k").agg(R(F.avg(out)).alias("reliability"), F.count(F.lit(1)).alias("n"))


def edgeness(spark, sf_dir):
    """Distance of the frame's centroid from its recording's median, in interquartile ranges."""
    c = a.keypoints(a.pose(spark, sf_dir)).groupBy("recording", "t").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    q = lambda col: F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    ref = c.groupBy("recording").agg(q("cx").alias("qx"), q("cy").alias("qy"))
    z = lambda v, s: (F.col(v) - F.get(s, 1)) / F.greatest(F.get(s, 2) - F.get(s, 0), F.lit(1e-9))
    out = c.join(ref, "recording")
    return out.select("recording", "t", R(F.sqrt(z("cx", "qx") ** 2 + z("cy", "qy") ** 2)).alias("edgeness"))


QUERIES = {f.__name__: f for f in (bone_lengths, rigid_pairs, reference_length, violations_mask, attribution, overlap_2x2, body_length_by_recording, egocentric, twist_se2, continuity_spike_step, suspects, reliability, edgeness)}


def _lengths_sql(pairs, name="len"):
    vals = ", ".join(f"({b}, {i}, {j})" for b, (i, j) in enumerate(pairs))
    return f"{name} AS (SELECT p.recording, p.t, b.bone, b.i, b.j, sqrt((p.x - q.x)**2 + (p.y - q.y)**2) AS d FROM (VALUES {vals}) b(bone, i, j) JOIN kp p ON p.k = b.i JOIN kp q ON q.k = b.j AND q.recording = p.recording AND q.t = p.t)"


#: One scan and no join: a row's bones from its own vector.
_LEN = f"""{a.POSE_SQL}, len AS (SELECT recording, t, bone, i, j, sqrt((e[2*i+1]::DOUBLE - e[2*j+1]::DOUBLE)**2 + (e[2*i+2]::DOUBLE - e[2*j+2]::DOUBLE)**2) AS d
  FROM pose, (VALUES {", ".join(f"({b}, {i}, {j})" for b, (i, j) in enumerate(g.BONES))}) b(bone, i, j))"""
_VIOL = f"{_LEN}, ref AS (SELECT recording, bone, quantile_cont(d, 0.9) AS l_hat FROM len GROUP BY ALL), viol AS (SELECT len.*, coalesce(d / l_hat > {1 + EPS}, false) AS viol FROM len JOIN ref USING (recording, bone))"
_MASK = f"{_VIOL}, vm AS (SELECT recording, t, bool_or(viol) AS violated, count(*) FILTER (viol) AS n_bones FROM viol GROUP BY ALL)"
_TRIM = "".join(f", r{i} AS (SELECT recording, bone, quantile_cont(d, 0.99) AS l_hat FROM len JOIN r{i - 1} USING (recording, bone) WHERE d <= l_hat * {1 + EPS} GROUP BY ALL)" for i in (1, 2, 3))
_SUSPECT = f"""{_VIOL}, hit AS (SELECT recording, t, count(*) AS n FROM viol WHERE viol GROUP BY ALL),
blame AS (SELECT recording, t, k, count(*) AS n FROM (SELECT recording, t, unnest([i, j]) AS k FROM viol WHERE viol) GROUP BY ALL),
best AS (SELECT recording, t, arg_min(k, (conf, k)) AS k FROM blame JOIN hit USING (recording, t, n) JOIN kp USING (recording, t, k) GROUP BY ALL),
sus AS (SELECT recording, t, n AS n_bones, coalesce(best.k, -1)::INT AS suspect FROM hit LEFT JOIN best USING (recording, t))"""
_BODY = f"{a.POSE_SQL}, body AS (SELECT recording, t, max(x) FILTER (k = 0) AS nx, max(y) FILTER (k = 0) AS ny, max(x) FILTER (k = 6) AS tx, max(y) FILTER (k = 6) AS ty, max(x) FILTER (k = 3) AS ox, max(y) FILTER (k = 3) AS oy FROM kp GROUP BY ALL), th AS (SELECT *, atan2(ny - ty, nx - tx) AS theta FROM body)"


def _resid_sql(name, shift):
    return f"""{name} AS (
  WITH o AS (SELECT a.recording, a.t, a.k, b.x AS ax, b.y AS ay, a.x AS qx, a.y AS qy FROM kp a JOIN kp b ON a.recording = b.recording AND a.k = b.k AND b.t = a.t + {shift}),
  m AS (SELECT l.recording, l.t, l.k, avg(r.ax) AS max_, avg(r.ay) AS may, avg(r.qx) AS mbx, avg(r.qy) AS mby FROM o l JOIN o r ON l.recording = r.recording AND l.t = r.t AND l.k <> r.k GROUP BY ALL),
  s AS (SELECT m.recording, m.t, m.k, any_value(max_) AS max_, any_value(may) AS may, any_value(mbx) AS mbx, any_value(mby) AS mby,
    sum((ax - max_) * (qx - mbx) + (ay - may) * (qy - mby)) AS re, sum((ax - max_) * (qy - mby) - (ay - may) * (qx - mbx)) AS im, sum((ax - max_)**2 + (ay - may)**2) AS den
    FROM m JOIN o ON o.recording = m.recording AND o.t = m.t AND o.k <> m.k GROUP BY m.recording, m.t, m.k)
  SELECT s.recording, s.t, s.k, sqrt(((qx - mbx) - (re / den * (ax - max_) - im / den * (ay - may)))**2 + ((qy - mby) - (im / den * (ax - max_) + re / den * (ay - may)))**2) AS r
  FROM s JOIN o USING (recording, t, k))"""


_PI = "pi()"
ORACLE = {
    "bone_lengths": f"WITH {_LEN} SELECT recording, t, bone, round(d, 6) AS d FROM len",
    "rigid_pairs": f"""WITH {a.POSE_SQL}, {_lengths_sql(g.all_pairs(7))}, l AS (SELECT recording, bone, ln(d) AS logd FROM len WHERE d > 0),
m AS (SELECT recording, bone, quantile_cont(logd, 0.5) AS med FROM l GROUP BY ALL), s AS (SELECT recording, bone, 1.4826 * quantile_cont(abs(logd - med), 0.5) AS mad FROM l JOIN m USING (recording, bone) GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT recording, quantile_cont(mad, 0.5) AS cut FROM s GROUP BY ALL) SELECT recording, bone, round(mad, 6) AS mad FROM s JOIN c USING (recording) WHERE mad <= cut""",
    "reference_length": f"WITH {_LEN}, r0 AS (SELECT recording, bone, quantile_cont(d, 0.99) AS l_hat FROM len GROUP BY ALL HAVING count(d) >= 10){_TRIM} SELECT recording, bone, round(l_hat, 6) AS l_hat FROM r3",
    "violations_mask": f"WITH {_MASK} SELECT * FROM vm",
    "attribution": f"WITH {_VIOL}, b AS (SELECT recording, t, unnest([i, j]) AS k FROM viol WHERE viol) SELECT k, count(DISTINCT (recording, t)) AS frames, round(count(*) / (SELECT count(*) FROM b), 6) AS share FROM b GROUP BY k",
    "overlap_2x2": f"""WITH {_MASK}, ms AS (SELECT recording, t, bool_or(missing) AS missing FROM kp GROUP BY ALL), c AS (SELECT recording, count(*) FILTER (violated AND missing) AS b, count(*) FILTER (violated AND NOT missing) AS v,
  count(*) FILTER (NOT violated AND missing) AS m, count(*) FILTER (NOT violated AND NOT missing) AS n FROM vm JOIN ms USING (recording, t) GROUP BY recording)
SELECT recording, b AS both, v AS only_viol, m AS only_missing, n AS neither, round(b / nullif(b + v + m, 0), 6) AS jaccard FROM c""",
    "body_length_by_recording": f"WITH {_BODY} SELECT recording, round(quantile_cont(sqrt((nx - tx)**2 + (ny - ty)**2), 0.5), 6) AS ell FROM body GROUP BY recording",
    "egocentric": f"WITH {_BODY} SELECT recording, t, k, round((cos(theta) * (x - ox) + sin(theta) * (y - oy)) / 0.5, 6) AS x, round((cos(theta) * (y - oy) - sin(theta) * (x - ox)) / 0.5, 6) AS y FROM kp JOIN th USING (recording, t)",
    "twist_se2": f"""WITH {_BODY}, n AS (SELECT *, lead(theta) OVER w - theta AS d, lead(ox) OVER w - ox AS dx, lead(oy) OVER w - oy AS dy FROM th WINDOW w AS (PARTITION BY recording ORDER BY t)),
u AS (SELECT recording, t, (d + {_PI}) - floor((d + {_PI}) / (2 * {_PI})) * 2 * {_PI} - {_PI} AS w, cos(theta) * dx + sin(theta) * dy AS ux, cos(theta) * dy - sin(theta) * dx AS uy FROM n),
c AS (SELECT *, CASE WHEN abs(w) < 1e-4 THEN 1 - w * w / 12 ELSE (w / 2) / tan(w / 2) END AS cot FROM u)
SELECT recording, t, round((cot * ux + w / 2 * uy) * 60, 5) AS v_x, round((cot * uy - w / 2 * ux) * 60, 5) AS v_y, round(w * 30, 5) AS omega FROM c""",
    "continuity_spike_step": f"WITH {a.POSE_SQL}, {_resid_sql('rm', -1)}, {_resid_sql('rp', 1)} SELECT recording, t, k, round(least(rm.r, rp.r), 6) AS spike, round(abs(rm.r - rp.r), 6) AS step FROM rm JOIN rp USING (recording, t, k)",
    "suspects": f"WITH {_SUSPECT} SELECT recording, t, n_bones, suspect FROM sus",
    "reliability": f"WITH {_SUSPECT} SELECT recording, k, round(avg(CASE WHEN suspect = -1 THEN 0 WHEN suspect = k THEN least(conf, 1) * 0.5 ELSE least(conf, 1) END), 6) AS reliability, count(*) AS n FROM kp LEFT JOIN sus USING (recording, t) GROUP BY ALL",
    "edgeness": f"""WITH {a.POSE_SQL}, c AS (SELECT recording, t, avg(x) AS cx, avg(y) AS cy FROM kp GROUP BY ALL), q AS (SELECT recording, quantile_cont(cx, 0.5) AS mx, quantile_cont(cy, 0.5) AS my,
  greatest(quantile_cont(cx, 0.75) - quantile_cont(cx, 0.25), 1e-9) AS ix, greatest(quantile_cont(cy, 0.75) - quantile_cont(cy, 0.25), 1e-9) AS iy FROM c GROUP BY ALL)
SELECT recording, t, round(sqrt(((cx - mx) / ix)**2 + ((cy - my) / iy)**2), 6) AS edgeness FROM c JOIN q USING (recording)""",
}
