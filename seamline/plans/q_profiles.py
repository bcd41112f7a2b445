"""Queries on summaries along recordings, controls and round trips."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seamline.operators import geometry as g
from seamline.operators import ordered as o
from seamline.operators import profiles as p
from seamline.operators import ranking as rk
from seamline.operators import resample as rs
from seamline.operators.segments import durable
from seamline.plans import q_geometry as qgeo
from seamline.plans import q_groupstats as qg
from seamline.plans import q_ordered as qo
from seamline.plans import q_segments as qs
from seamline.sources import adapters as a

R = lambda c, n=6: F.round(c, n)
#: Members of a component that are measured at most: larger ones are drawn from.
MEMBERS = 400


def equal_windows(spark, sf_dir):
    out = p.equal_windows(a.frames(spark, sf_dir), "x")
    return out.select("recording", "part", "n", R("mean").alias("mean"), R("sd").alias("sd"))


def causal_smooth(spark, sf_dir):
    return p.causal_mean(a.frames(spark, sf_dir), "x", 4, "y").select("recording", "t", R("y").alias("y"))


def cubic_fit_quality(spark, sf_dir):
    f = a.frames(spark, sf_dir).withColumn("block", F.floor(F.col("t") / 12).cast("bigint"))
    out = p.cubic_fit(f, ["recording", "block"], "x")
    return out.select("recording", "block", "n", R("r2", 5).alias("r2"), R("r2_adj", 5).alias("r2_adj"))


def window_template(spark, sf_dir):
    return p.template(a.frames(spark, sf_dir).select("recording", "t", "x"), "x", 10, 40).select(F.col("offset").cast("bigint").alias("offset"), "n", R("mean").alias("mean"))


def reversed_twist(spark, sf_dir):
    t = qgeo.twist_se2(spark, sf_dir).select("recording", "t", "v_x", "v_y", "omega")
    return p.reverse(t, ["v_x", "v_y", "omega"])


def inverse_roundtrip(spark, sf_dir):
    """Largest error of keypoints taken to the body frame and back."""
    e = g.egocentric(a.pose(spark, sf_dir), F.lit(0.5))
    e = e.withColumn("o", F.get("pose", g.ORIGIN)).select("recording", "theta", "o", F.explode(F.arrays_zip("pose", "ego")).alias("z"))
    c, s = F.cos("theta"), F.sin("theta")
    x = F.col("o.x") + 0.5 * (c * F.col("z.ego.x") - s * F.col("z.ego.y"))
    y = F.col("o.y") + 0.5 * (s * F.col("z.ego.x") + c * F.col("z.ego.y"))
    err = F.greatest(F.abs(x - F.col("z.pose.x")), F.abs(y - F.col("z.pose.y")))
    return e.groupBy("recording").agg(F.count(F.lit(1)).alias("n"), R(F.max(err)).alias("worst"))


def reassignment(spark, sf_dir):
    """Share of keypoint frames that interpolation moved, per keypoint and (k NULL) over all."""
    kp = o.held(a.keypoints(a.pose(spark, sf_dir)), ["recording", "k"], "x", "missing", "hx")
    d = durable(kp.select("k", F.abs(F.col("x") - F.col("hx")).alias("d")))
    moved = F.col("d") > 1e-9
    out = d.rollup("k").agg(F.count(F.lit(1)).alias("n"), R(F.avg(moved.cast("int"))).alias("moved"), R(F.max("d")).alias("largest"))
    mid = {"median": 0.5}
    far = d.where(moved)
    medians = rk.quantiles_by(far, "d", mid, ["k"]).unionByName(rk.quantiles_by(far, "d", mid).withColumn("k", F.lit(None).cast("int")))
    return out.join(medians.withColumnRenamed("k", "_k"), F.col("k").eqNullSafe(F.col("_k")), "left").select("k", "n", "moved", "largest", R("median").alias("median"))


def shuffled_ceiling(spark, sf_dir):
    """Rate of over-long bones when each keypoint comes from a frame of its own draw."""
    kp = a.keypoints(a.pose(spark, sf_dir)).select("recording", "t", "k", "x", "y")
    n = F.count(F.lit(1)).over(Window.partitionBy("recording", "k"))
    src = kp.withColumn("n", n).select("recording", "t", "k", F.pmod(rs.draw("ceiling", F.col("recording"), F.col("k"), F.col("t")), F.col("n")).alias("s"))
    mixed = src.join(kp.select("recording", "k", F.col("t").alias("s"), "x", "y"), ["recording", "k", "s"])
    bones = F.broadcast(spark.createDataFrame([(b, i, j) for b, (i, j) in enumerate(g.BONES)], "bone int, i int, j int"))
    left = mixed.select("recording", "t", F.col("k").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay")).join(bones, "i")
    both = left.join(mixed.select("recording", "t", F.col("k").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by")), ["recording", "t", "j"])
    d = both.withColumn("d", F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2))
    ref = qgeo.lengths(spark, sf_dir).groupBy("recording", "bone").agg(F.percentile("d", 0.9).alias("l_hat"))
    out = d.join(ref, ["recording", "bone"])
    return out.groupBy("bone").agg(F.count(F.lit(1)).alias("n"), R(F.avg((F.col("d") / F.col("l_hat") > 1 + qgeo.EPS).cast("int"))).alias("rate"))


def bout_balanced_sd(spark, sf_dir):
    """Deviation of the signal in which every run weighs alike."""
    f, r = a.frames(spark, sf_dir), qo.runs(spark, sf_dir)
    starts = r.select("recording", F.col("start_t").alias("t"), "run_id")
    w = Window.partitionBy("recording").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    f = f.join(starts, ["recording", "t"], "left").withColumn("run", F.last("run_id", True).over(w))
    per = f.groupBy("animal", "recording", "run").agg(F.var_pop("x").alias("v"))
    return per.groupBy("animal").agg(F.count(F.lit(1)).alias("bouts"), R(F.sqrt(F.avg("v"))).alias("sd"))


def smoothing_r2(spark, sf_dir):
    s = o.savgol_interior(a.frames(spark, sf_dir), ["recording"], "x", 7, "y")
    return p.r2(s, ["recording"], "x", "y").select("recording", "n", R("r2").alias("r2"))


def fdr_per_animal(spark, sf_dir):
    """Sign-flip p of each animal's paired differences, and which are discoveries."""
    d = qg.paired_deltas(spark, sf_dir).withColumn("pair", F.concat_ws("-", "animal", "day"))
    reps = d.crossJoin(F.broadcast(spark.range(100).withColumnRenamed("id", "rep")))
    sign = F.when(rs.draw("fdr", F.col("rep"), F.col("pair")) % 2 == 0, 1).otherwise(-1)
    null = reps.groupBy("animal", "rep").agg(F.avg(F.col("delta") * sign).alias("m"))
    obs = d.groupBy("animal").agg(F.avg("delta").alias("obs"))
    per = null.join(obs, "animal").groupBy("animal").agg(R((F.sum((F.abs(F.col("m")) >= F.abs(F.col("obs")) - 1e-12).cast("int")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
    return p.false_discoveries(per.select("animal", "p"), q=0.5).select("animal", "p", "rank", "rejected")


def detectable_effect(spark, sf_dir):
    """Smallest detectable difference of a rate with an animal's lines: normal quantiles for 5% and 80%."""
    c = qg._counts(spark, sf_dir).groupBy().agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    n = a.groups(spark, sf_dir).groupBy("animal").agg(F.count(F.lit(1)).alias("m"))
    rate = F.col("k") / F.col("n")
    return n.crossJoin(F.broadcast(c)).select("animal", F.col("m").alias("n"), R((1.959963985 + 0.841621234) * F.sqrt(rate * (1 - rate) / F.col("m"))).alias("mde"))


def clump_diameter(spark, sf_dir):
    """Widest and median distance among a component's members, up to 400 of them by draw (a sampling operator by its contract)."""
    c = qs.clump_components(spark, sf_dir).join(a.bank(spark, sf_dir).select("unit", "vec"), "unit")
    c = rs.subsample(c, "unit", MEMBERS, 5, ("component",))
    pair = c.alias("l").join(c.alias("r"), F.col("l.component") == F.col("r.component"))
    d = F.sqrt(F.aggregate(F.zip_with("l.vec", "r.vec", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    out = pair.select(F.col("l.component").alias("component"), d.alias("d"))
    return out.groupBy("component").agg(R(F.max("d")).alias("widest"), R(F.percentile("d", 0.5)).alias("median"))


def length_match_control(spark, sf_dir):
    """Mean log-length gap between a run and the next one, and between a run and a permuted one."""
    r = qo.runs(spark, sf_dir).where("code <> -1").select("recording", "run_id", "duration")
    nxt = F.lead("duration").over(Window.partitionBy("recording").orderBy("run_id"))
    r = r.withColumn("nxt", nxt).where("nxt is not null")
    key = F.concat_ws("-", "recording", "run_id")
    r = r.withColumns({"i": F.row_number().over(Window.partitionBy("recording").orderBy("run_id")), "j": F.row_number().over(Window.partitionBy("recording").orderBy(rs.draw("permute", key), "run_id"))})
    both = r.join(r.select("recording", F.col("j").alias("i"), F.col("nxt").alias("perm")), ["recording", "i"])
    gap = lambda c: R(F.avg(F.abs(F.log("duration") - F.log(c))))
    return both.groupBy("recording").agg(F.count(F.lit(1)).alias("n"), gap("nxt").alias("gap"), gap("perm").alias("permuted_gap"))


def worst_recordings(spark, sf_dir):
    """The five recordings of highest abstaining share, and five drawn from the rest: a report with a fixed length."""
    s = a.frames(spark, sf_dir).groupBy("recording").agg(R(F.avg((F.col("code") == -1).cast("int"))).alias("share"))
    worst = s.orderBy(F.desc("share"), "recording").limit(5)
    rest = rs.subsample(s.join(worst.select("recording"), "recording", "left_anti"), "recording", 5, 9)
    return worst.withColumn("pick", F.lit("worst")).unionByName(rest.withColumn("pick", F.lit("drawn")))


QUERIES = {f.__name__: f for f in (equal_windows, causal_smooth, cubic_fit_quality, window_template, reversed_twist, inverse_roundtrip, reassignment, shuffled_ceiling, bout_balanced_sd, smoothing_r2, fdr_per_animal, detectable_effect, clump_diameter, length_match_control, worst_recordings)}

_D = qg._draw
_TW = qgeo.ORACLE["twist_se2"]
_HELD = qo.ORACLE["held_interpolation"]
_SGV = qo.ORACLE["savgol_interior"]
ORACLE = {
    "equal_windows": f"WITH {a.FRAMES_SQL}, w AS (SELECT recording, x, ((8 * (t + 1) - 1) // count(*) OVER (PARTITION BY recording))::INT AS part FROM frames) SELECT recording, part, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM w GROUP BY ALL",
    "causal_smooth": f"WITH {a.FRAMES_SQL} SELECT recording, t, round(CASE WHEN row_number() OVER w > 4 THEN avg(x) OVER (PARTITION BY recording ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END, 6) AS y FROM frames WINDOW w AS (PARTITION BY recording ORDER BY t)",
    "cubic_fit_quality": f"""WITH {a.FRAMES_SQL}, b AS (SELECT recording, t // 12 AS block, count(*) OVER g AS n, t - avg(t) OVER g AS u, x - avg(x) OVER g AS y FROM frames WINDOW g AS (PARTITION BY recording, t // 12)),
s AS (SELECT recording, block, n, sum(u * y) AS s1, sum(u * u) AS q1, sum((u**2 - (n**2 - 1) / 12) * y) AS s2, sum((u**2 - (n**2 - 1) / 12)**2) AS q2, sum((u**3 - u * (3 * n**2 - 7) / 20) * y) AS s3, sum((u**3 - u * (3 * n**2 - 7) / 20)**2) AS q3, sum(y * y) AS sst FROM b WHERE n >= 5 GROUP BY ALL),
r AS (SELECT *, (s1**2 / q1 + s2**2 / q2 + s3**2 / q3) / nullif(sst, 0) AS r2 FROM s) SELECT recording, block, n, round(r2, 5) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 4), 5) AS r2_adj FROM r""",
    "window_template": f"""WITH {a.FRAMES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY recording) AS n FROM frames), s AS (SELECT recording, t AS s FROM n WHERE t + 10 <= n ORDER BY {_D("'template'", "recording", "t")}, recording, t LIMIT 40)
SELECT f.t - s AS offset, count(*) AS n, round(avg(x), 6) AS mean FROM s JOIN frames f ON f.recording = s.recording AND f.t >= s AND f.t < s + 10 GROUP BY ALL""",
    "reversed_twist": f"WITH tw AS ({_TW}), n AS (SELECT *, count(*) OVER (PARTITION BY recording) AS n FROM tw) SELECT recording, n - 2 - t AS t, -v_x AS v_x, -v_y AS v_y, -omega AS omega FROM n WHERE n - 2 - t >= 0",
    "inverse_roundtrip": f"""WITH {qgeo._BODY}, e AS (SELECT kp.recording, x, y, ox, oy, cos(theta) AS c, sin(theta) AS s, (cos(theta) * (x - ox) + sin(theta) * (y - oy)) / 0.5 AS ex, (cos(theta) * (y - oy) - sin(theta) * (x - ox)) / 0.5 AS ey FROM kp JOIN th USING (recording, t))
SELECT recording, count(*) AS n, round(max(greatest(abs(ox + 0.5 * (c * ex - s * ey) - x), abs(oy + 0.5 * (s * ex + c * ey) - y))), 6) AS worst FROM e GROUP BY recording""",
    "reassignment": f"""WITH {a.POSE_SQL}, hd AS ({_HELD.replace('round(CASE', 'CASE', 1).replace('ELSE x END, 6) AS held_x', 'ELSE x END AS held_x', 1)}), d AS (SELECT k, abs(x - held_x) AS d FROM kp JOIN hd USING (recording, t, k))
SELECT k, count(*) AS n, round(avg((d > 1e-9)::INT), 6) AS moved, round(max(d), 6) AS largest, round(quantile_cont(CASE WHEN d > 1e-9 THEN d END, 0.5), 6) AS median FROM d GROUP BY ROLLUP (k)""",
    "shuffled_ceiling": f"""WITH {qgeo._LEN}, ref AS (SELECT recording, bone, quantile_cont(d, 0.9) AS l_hat FROM len GROUP BY ALL), sr AS (SELECT recording, t, k, {_D("'ceiling'", "recording", "k", "t")} % count(*) OVER (PARTITION BY recording, k) AS s FROM kp),
mx AS (SELECT sr.recording, sr.t, sr.k, kp.x, kp.y FROM sr JOIN kp ON kp.recording = sr.recording AND kp.k = sr.k AND kp.t = sr.s),
ds AS (SELECT p.recording, b.bone, sqrt((p.x - q.x)**2 + (p.y - q.y)**2) AS d FROM (VALUES {", ".join(f"({b}, {i}, {j})" for b, (i, j) in enumerate(g.BONES))}) b(bone, i, j) JOIN mx p ON p.k = b.i JOIN mx q ON q.k = b.j AND q.recording = p.recording AND q.t = p.t)
SELECT bone, count(*) AS n, round(avg((d / l_hat > {1 + qgeo.EPS})::INT), 6) AS rate FROM ds JOIN ref USING (recording, bone) GROUP BY bone""",
    "bout_balanced_sd": f"WITH {qo.RUNS_SQL}, v AS (SELECT animal, recording, run_id, var_pop(x) AS v FROM numbered GROUP BY ALL) SELECT animal, count(*) AS bouts, round(sqrt(avg(v)), 6) AS sd FROM v GROUP BY animal",
    "smoothing_r2": f"""WITH sg AS ({_SGV.replace(', round((', ', x, ((', 1).replace('/ 21.0, 6)', '/ 21.0)', 1)}), b AS (SELECT recording, x, smooth AS y, avg(x) OVER (PARTITION BY recording) AS m FROM sg WHERE smooth IS NOT NULL)
SELECT recording, count(*) AS n, round(1 - sum((x - y)**2) / nullif(sum((x - m)**2), 0), 6) AS r2 FROM b GROUP BY recording""",
    "fdr_per_animal": f"""WITH {qg._DELTA}, m AS (SELECT animal, rep, avg(delta * CASE WHEN {_D("'fdr'", "rep", "(animal || '-' || day)")} % 2 = 0 THEN 1 ELSE -1 END) AS m FROM dl, range(100) r(rep) GROUP BY ALL), ob AS (SELECT animal, avg(delta) AS obs FROM dl GROUP BY 1),
p AS (SELECT animal, round((count(*) FILTER (abs(m) >= abs(obs) - 1e-12) + 1) / (count(*) + 1), 6) AS p FROM m JOIN ob USING (animal) GROUP BY animal), r AS (SELECT *, row_number() OVER (ORDER BY p, animal)::INT AS rank, count(*) OVER () AS m FROM p)
SELECT animal, p, rank, coalesce(rank <= max(CASE WHEN p <= 0.5 * rank / m THEN rank END) OVER (), false) AS rejected FROM r""",
    "detectable_effect": f"WITH {a.GROUPS_SQL}, q AS (SELECT avg(mask::INT) AS p FROM groups) SELECT animal, count(*) AS n, round((1.959963985 + 0.841621234) * sqrt(any_value(p) * (1 - any_value(p)) / count(*)), 6) AS mde FROM groups, q GROUP BY animal",
    "clump_diameter": f"""WITH RECURSIVE {qs._COMP}, sm AS (SELECT * FROM (SELECT component, unit, embedding, row_number() OVER (PARTITION BY component ORDER BY {_D("5", "unit")}, unit) AS r FROM cp JOIN embeddings ON vec_id = unit) WHERE r <= {MEMBERS})
SELECT l.component, round(max(list_distance(l.embedding::DOUBLE[], r.embedding::DOUBLE[])), 6) AS widest, round(quantile_cont(list_distance(l.embedding::DOUBLE[], r.embedding::DOUBLE[]), 0.5), 6) AS median FROM sm l JOIN sm r USING (component) GROUP BY l.component""",
    "length_match_control": f"""WITH {qo.RUNS_SQL}, l AS (SELECT recording, run_id, duration, lead(duration) OVER (PARTITION BY recording ORDER BY run_id) AS nxt FROM runs WHERE code <> -1), k AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY run_id) AS i,
  row_number() OVER (PARTITION BY recording ORDER BY {_D("'permute'", "(recording || '-' || run_id)")}, run_id) AS j FROM l WHERE nxt IS NOT NULL)
SELECT x.recording, count(*) AS n, round(avg(abs(ln(x.duration) - ln(x.nxt))), 6) AS gap, round(avg(abs(ln(x.duration) - ln(y.nxt))), 6) AS permuted_gap FROM k x JOIN k y ON x.recording = y.recording AND x.i = y.j GROUP BY x.recording""",
    "worst_recordings": f"""WITH {a.FRAMES_SQL}, s AS (SELECT recording, round(avg((code = -1)::INT), 6) AS share FROM frames GROUP BY 1), w AS (SELECT * FROM s ORDER BY share DESC, recording LIMIT 5),
d AS (SELECT * FROM s WHERE recording NOT IN (SELECT recording FROM w) ORDER BY {_D("9", "recording")}, recording LIMIT 5) SELECT *, 'worst' AS pick FROM w UNION ALL SELECT *, 'drawn' FROM d""",
}
