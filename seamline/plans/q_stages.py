"""Whole stages: each query is the composition of a stage's operators, from the tables to its pooled result.

What a stage computes once for several branches is written once to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seamline.operators import geometry as g
from seamline.operators import groupstats as gs
from seamline.operators import ordered as o
from seamline.operators import resample as rs
from seamline.operators import search as se
from seamline.operators import segments as sg
from seamline.operators.segments import durable
from seamline.plans import q_geometry as qgeo
from seamline.plans import q_groupstats as qg
from seamline.plans import q_intervals as qi
from seamline.plans import q_more as qm
from seamline.plans import q_segments as qs
from seamline.plans.q_tables import HALVES
from seamline.sources import adapters as a

R = lambda c, n=6: F.round(c, n)
TOLERANCES = (0.05, 0.1, 0.2, 0.4, 0.8)
#: Half widths and thresholds of the boundary sweep; the cell that the others are held against.
WIDTHS, LEVELS, BASE = (2, 3, 4), (0.5, 1.0, 1.5, 2.0, 3.0, 4.0), 7
CELLS = len(WIDTHS) * len(LEVELS)
#: Points that a unit is resampled to, and its least length.
GRID, SHORTEST = 8, 4
CLIFF = 3


def stage_bones(spark, sf_dir):
    """Violations of two length metrics, five tolerances and two halves of the body, and how far they overlap with missing points."""
    pose = durable(a.pose(spark, sf_dir))
    d = g.bone_lengths(pose).select("recording", "t", "bone", "d").where("d > 0")
    scale = F.percentile(F.log("d"), 0.5).over(Window.partitionBy("recording", "t"))
    both = d.withColumn("free", F.col("d") / F.exp(scale))
    rows = durable(both.select("recording", "t", "bone", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("v")) for m, c in (("raw", "d"), ("free", "free"))])).alias("m")).select("recording", "t", "bone", "m.*"))
    ref = rows.groupBy("metric", "recording", "bone").agg(F.percentile("v", 0.9).alias("l_hat"))
    half = F.when(F.col("bone").isin(*HALVES["front"]), "front").otherwise("back")
    eps = F.explode(F.array(*[F.lit(e) for e in TOLERANCES])).alias("eps")
    over = rows.join(ref, ["metric", "recording", "bone"]).select("metric", "recording", "t", half.alias("half"), (F.col("v") / F.col("l_hat")).alias("ratio"), eps)
    frames = over.groupBy("metric", "half", "eps", "recording", "t").agg(F.bool_or(F.col("ratio") > 1 + F.col("eps")).alias("viol"))
    missing = pose.select("recording", "t", F.exists("missing", lambda m: m).alias("gap"))
    n = lambda c: F.sum(c.cast("long"))
    v, m = F.col("viol"), F.col("gap")
    per = frames.join(missing, ["recording", "t"]).groupBy("metric", "half", "eps", "recording").agg(F.count(F.lit(1)).alias("n"), n(v).alias("hit"), n(v & m).alias("met"), n(v | m).alias("any"))
    out = per.groupBy("metric", "half", "eps").agg(F.sum("n").alias("n"), R(F.sum("hit") / F.sum("n")).alias("rate"), R(F.try_divide(F.sum("met"), F.sum("any"))).alias("jaccard"), R(F.max(F.col("hit") / F.col("n"))).alias("worst"))
    return out.select("metric", "half", "eps", "n", "rate", "jaccard", "worst")


def stage_breaks(spark, sf_dir):
    """Boundaries in eighteen cells of width and threshold: how many, how often, and how far each cell's set agrees with the base cell's."""
    f, peaks = durable(a.frames(spark, sf_dir).select("recording", "t", "code", "x")), None
    w = Window.partitionBy("recording").orderBy("t")
    for i, h in enumerate(WIDTHS):
        d = durable(sg.discontinuity(f, ["x"], h).select("recording", "t", "code", R("d").alias("d")))
        med = d.groupBy("recording").agg(F.percentile("d", 0.5).alias("med"))
        mad = d.join(med, "recording").groupBy("recording", "med").agg(F.percentile(F.abs(F.col("d") - F.col("med")), 0.5).alias("mad"))
        level = F.explode(F.array(*[F.struct(F.lit(i * len(LEVELS) + j).alias("cell"), F.lit(k).alias("k")) for j, k in enumerate(LEVELS)])).alias("l")
        top = d.withColumns({"p": F.lag("d").over(w), "q": F.lead("d").over(w)}).where("d >= p and d > q and code <> -1").join(mad, "recording").select("recording", "t", "d", "med", "mad", level)
        one = top.where("d > med + l.k * 1.4826 * (mad + 1e-12)").select((F.col("recording") * CELLS + F.col("l.cell")).alias("recording"), "t", "d")
        peaks = one if peaks is None else peaks.unionByName(one)
    kept = sg.suppress(peaks, qs.GAP).select(F.floor(F.col("recording") / CELLS).alias("recording"), F.pmod("recording", F.lit(CELLS)).cast("int").alias("cell"), "t")
    kept = durable(kept)
    base = kept.where(F.col("cell") == BASE).select("recording", "t", F.lit(1).alias("hit"))
    size = base.agg(F.count(F.lit(1)).alias("base"))
    seconds = f.agg((F.count(F.lit(1)) / 30.0).alias("seconds"))
    cells = spark.createDataFrame([(i * len(LEVELS) + j, h, k) for i, h in enumerate(WIDTHS) for j, k in enumerate(LEVELS)], "cell int, h int, k double")
    found = kept.join(base, ["recording", "t"], "left").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("met"), F.count_distinct("recording").alias("recordings"))
    out = cells.join(found, "cell", "left").na.fill(0, ["n", "met", "recordings"]).crossJoin(F.broadcast(size)).crossJoin(F.broadcast(seconds))  # one row each
    return out.select("h", "k", "n", "recordings", R(F.col("n") / F.col("seconds")).alias("rate"), R(F.try_divide(F.col("met"), F.col("n") + F.col("base") - F.col("met"))).alias("agreement"))


def _arms(spark, sf_dir):
    """Runs of the codes as they are, with abstention bridged by the code before, and with single odd frames taken out."""
    f = durable(a.frames(spark, sf_dir).select("recording", "animal", "t", "code"))
    w = Window.partitionBy("recording").orderBy("t")
    held = F.coalesce(F.last(F.when(F.col("code") != -1, F.col("code")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1))
    before, after = F.lag("code").over(w), F.lead("code").over(w)
    odd = F.when((before == after) & (before != F.col("code")), before).otherwise(F.col("code"))
    out = None
    for arm, code in (("raw", F.col("code")), ("bridged", held), ("smoothed", odd)):
        runs = o.encode(f.withColumn("code", code), ["animal"]).where("code <> -1").select(F.lit(arm).alias("arm"), "animal", "duration")
        out = runs if out is None else out.unionByName(runs)
    return durable(out)


def stage_run_lengths(spark, sf_dir):
    """Pooled run lengths of three arms, the mass in short runs by animal with its interval, and the mass over the cliff against the raw arm's."""
    runs = _arms(spark, sf_dir)
    d = F.col("duration")
    mass = lambda c: F.sum(F.when(c, d).otherwise(0)) / F.sum(d)
    pooled = runs.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("frames"), F.percentile(d, 0.5).alias("median"), R(F.avg(d)).alias("mean"), R(mass(d > CLIFF)).alias("mass_over"))
    per = durable(runs.groupBy("arm", "animal").agg(R(mass(d <= CLIFF)).alias("short"), F.lit(1.0).alias("w")))
    out = None
    for arm in ("raw", "bridged", "smoothed"):
        one = rs.cluster_interval(per.where(F.col("arm") == arm), "animal", "short", "w", n_boot=qg.N_BOOT).withColumn("arm", F.lit(arm))
        out = one if out is None else out.unionByName(one)
    raw = pooled.where("arm = 'raw'").select(F.col("mass_over").alias("raw_over"))
    both = pooled.join(out, "arm").crossJoin(F.broadcast(raw))  # one row
    kept = F.try_divide(F.col("mass_over"), F.col("raw_over"))
    return both.select("arm", "n", "frames", "median", "mean", "mass_over", R(kept).alias("kept"), R("point").alias("short"), R("lo").alias("lo"), R("hi").alias("hi"), "n_clusters")


def resampled(frames, units):
    """(kind, unit, animal, vec): each unit (kind, unit, recording, start, stop) at ``GRID`` points of equal spacing, ends kept.

    Every point is an equi-join with the two frames beside it, whatever the unit's length.
    """
    pos = F.col("start") + F.col("i") * (F.col("stop") - 1 - F.col("start")) / (GRID - 1)
    pts = units.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))).withColumn("pos", pos).withColumn("lo", F.floor("pos"))
    pts = pts.withColumn("hi", F.least(F.col("lo") + 1, F.col("stop") - 1))
    at = lambda key, x: frames.select("recording", F.col("t").alias(key), F.col("x").alias(x))
    met = pts.join(at("lo", "a"), ["recording", "lo"]).join(at("hi", "b"), ["recording", "hi"])
    y = R(F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.col("lo")), 9)
    vec = F.transform(F.sort_array(F.collect_list(F.struct("i", y.alias("y")))), lambda z: z["y"])  # GRID points
    return met.groupBy("kind", "unit", "recording").agg(vec.alias("vec")).select("kind", "unit", (F.col("recording") % 10).alias("animal"), "vec")


def stage_recurrence(spark, sf_dir):
    """Do found segments recur in other animals more than windows of the same lengths? By animal, at the windows' 10% quantile.

    Both kinds of unit are resampled alike, each has its own bank, and each unit its exact nearest neighbour in another animal.
    """
    seg = durable(qs._segments(spark, sf_dir))
    windows = qi.matched_windows(spark, sf_dir).where(F.col("n_frames") >= SHORTEST)
    units = seg.where((F.col("n_frames") >= SHORTEST) & (F.col("abstain_frac") == 0)).select(F.lit("segment").alias("kind"), (F.col("recording") * 1000 + F.col("start")).alias("unit"), "recording", "start", "stop")
    units = units.unionByName(windows.select(F.lit("window").alias("kind"), F.col("draw").alias("unit"), "recording", "start", "stop"))
    bank = durable(resampled(a.frames(spark, sf_dir), units))
    near = None
    for kind in ("segment", "window"):
        own = bank.where(F.col("kind") == kind)
        one = se.knn(own, 1).select(F.lit(kind).alias("kind"), F.col("query").alias("unit"), R("dist").alias("d"))
        near = one if near is None else near.unionByName(one)
    near = durable(near.join(bank.select("kind", "unit", "animal"), ["kind", "unit"]))
    theta = gs.quantiles(near.where("kind = 'window'"), "d", [0.1])
    if not theta:
        return near.selectExpr("animal", "0L as segments", "0L as windows", "d as segment_median", "d as window_median", "d as excess").limit(0)
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    hit = (F.col("d") <= theta[0]).cast("int")
    out = near.groupBy("animal").agg(
        F.count(of("segment", F.lit(1))).alias("segments"), F.count(of("window", F.lit(1))).alias("windows"), R(F.percentile(of("segment", F.col("d")), 0.5)).alias("segment_median"),
        R(F.percentile(of("window", F.col("d")), 0.5)).alias("window_median"), R(F.avg(of("segment", hit)) - F.avg(of("window", hit))).alias("excess"),
    )
    return out


QUERIES = {f.__name__: f for f in (stage_bones, stage_breaks, stage_run_lengths, stage_recurrence)}


def _d_sql(h):
    weights = sg.curvature_weights(h)
    right, left = (" + ".join(f"{v!r} * {fn}(x, {i}) OVER w" for i, v in enumerate(weights)) for fn in ("lead", "lag"))
    return f"SELECT recording, t, code, {h} AS h, round(coalesce(abs(({right}) - ({left})), 0), 6) AS d FROM frames WINDOW w AS (PARTITION BY recording ORDER BY t)"


_ARM = lambda arm, code: f"""SELECT '{arm}' AS arm, animal, count(*) AS duration FROM (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY t ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT recording, animal, t, c, CASE WHEN lag(c) OVER (PARTITION BY recording ORDER BY t) = c THEN 0 ELSE 1 END AS new FROM (SELECT *, {code} AS c FROM frames))) WHERE c <> -1 GROUP BY recording, animal, g, c"""  # noqa: E731
_HELD = "coalesce(last_value(nullif(code, -1) IGNORE NULLS) OVER (PARTITION BY recording ORDER BY t ROWS UNBOUNDED PRECEDING), -1)"
_ODD = "CASE WHEN lag(code) OVER (PARTITION BY recording ORDER BY t) = lead(code) OVER (PARTITION BY recording ORDER BY t) AND lag(code) OVER (PARTITION BY recording ORDER BY t) <> code THEN lag(code) OVER (PARTITION BY recording ORDER BY t) ELSE code END"
_RUN_ARMS = f"{a.FRAMES_SQL}, arms AS ({_ARM('raw', 'code')} UNION ALL {_ARM('bridged', _HELD)} UNION ALL {_ARM('smoothed', _ODD)})"
_SHORT = lambda arm: f"WITH {_RUN_ARMS} SELECT animal, round(coalesce(sum(duration) FILTER (duration <= {CLIFF}), 0) / sum(duration), 6) AS short FROM arms WHERE arm = '{arm}' GROUP BY animal"
ORACLE = {
    "stage_bones": f"""WITH {qgeo._LEN}, s AS (SELECT recording, t, bone, d, d / exp(quantile_cont(ln(d), 0.5) OVER (PARTITION BY recording, t)) AS free FROM len WHERE d > 0),
m AS (SELECT 'raw' AS metric, recording, t, bone, d AS v FROM s UNION ALL SELECT 'free', recording, t, bone, free FROM s), ref AS (SELECT metric, recording, bone, quantile_cont(v, 0.9) AS l_hat FROM m GROUP BY ALL),
fr AS (SELECT metric, CASE WHEN bone <= 2 THEN 'front' ELSE 'back' END AS half, eps, recording, t, bool_or(v / l_hat > 1 + eps) AS viol FROM m JOIN ref USING (metric, recording, bone), (SELECT unnest([{", ".join(map(str, TOLERANCES))}])::DOUBLE AS eps) GROUP BY ALL),
gp AS (SELECT recording, t, bool_or(missing) AS gap FROM kp GROUP BY ALL),
p AS (SELECT metric, half, eps, recording, count(*) AS n, count(*) FILTER (viol) AS hit, count(*) FILTER (viol AND gap) AS met, count(*) FILTER (viol OR gap) AS anyof FROM fr JOIN gp USING (recording, t) GROUP BY ALL)
SELECT metric, half, eps, sum(n)::BIGINT AS n, round(sum(hit) / sum(n), 6) AS rate, round(sum(met) / nullif(sum(anyof), 0), 6) AS jaccard, round(max(hit / n), 6) AS worst FROM p GROUP BY metric, half, eps""",
    "stage_breaks": f"""WITH RECURSIVE {a.FRAMES_SQL}, dd AS ({" UNION ALL ".join(f"({_d_sql(h)})" for h in WIDTHS)}), md AS (SELECT h, recording, quantile_cont(d, 0.5) AS med FROM dd GROUP BY ALL), m2 AS (SELECT h, recording, any_value(med) AS med, quantile_cont(abs(d - med), 0.5) AS mad FROM dd JOIN md USING (h, recording) GROUP BY ALL),
cl AS (SELECT * FROM (VALUES {", ".join(f"({i * len(LEVELS) + j}, {h}, {k}::DOUBLE)" for i, h in enumerate(WIDTHS) for j, k in enumerate(LEVELS))}) c(cell, h, k)),
pk AS (SELECT p.recording, cell, t, d FROM (SELECT *, lag(d) OVER w AS pa, lead(d) OVER w AS pb FROM dd WINDOW w AS (PARTITION BY h, recording ORDER BY t)) p JOIN m2 ON m2.h = p.h AND m2.recording = p.recording JOIN cl ON cl.h = p.h WHERE d >= pa AND d > pb AND code <> -1 AND d > med + k * 1.4826 * (mad + 1e-12)),
rk AS (SELECT *, row_number() OVER (PARTITION BY recording, cell ORDER BY d DESC, t) AS r FROM pk),
go(recording, cell, r, kept) AS (SELECT recording, cell, 1::BIGINT, [t] FROM rk WHERE r = 1
  UNION ALL SELECT go.recording, go.cell, rk.r, CASE WHEN len(list_filter(go.kept, lambda x: abs(x - rk.t) < {qs.GAP})) = 0 THEN list_append(go.kept, rk.t) ELSE go.kept END FROM go JOIN rk ON rk.recording = go.recording AND rk.cell = go.cell AND rk.r = go.r + 1),
kp AS (SELECT recording, cell, unnest(kept) AS t FROM (SELECT recording, cell, arg_max(kept, r) AS kept FROM go GROUP BY ALL)), bs AS (SELECT recording, t FROM kp WHERE cell = {BASE}),
n AS (SELECT cell, count(*) AS n, count(bs.t) AS met, count(DISTINCT kp.recording) AS recordings FROM kp LEFT JOIN bs ON bs.recording = kp.recording AND bs.t = kp.t GROUP BY cell)
SELECT h, k, coalesce(n, 0) AS n, coalesce(recordings, 0) AS recordings, round(coalesce(n, 0) / ((SELECT count(*) FROM frames) / 30.0::DOUBLE), 6) AS rate, round(coalesce(met, 0) / nullif(coalesce(n, 0) + (SELECT count(*) FROM bs) - coalesce(met, 0), 0), 6) AS agreement FROM cl LEFT JOIN n USING (cell)""",
    "stage_run_lengths": f"""WITH {_RUN_ARMS}, p AS (SELECT arm, count(*) AS n, sum(duration)::BIGINT AS frames, quantile_cont(duration, 0.5) AS median, round(avg(duration), 6) AS mean, round(coalesce(sum(duration) FILTER (duration > {CLIFF}), 0) / sum(duration), 6) AS mass_over FROM arms GROUP BY arm),
i AS ({" UNION ALL ".join(f"SELECT '{arm}' AS arm, * FROM ({qm._boot(_SHORT(arm), 'short')})" for arm in ("raw", "bridged", "smoothed"))})
SELECT arm, n, frames, median::DOUBLE AS median, mean, mass_over, round(mass_over / nullif((SELECT mass_over FROM p WHERE arm = 'raw'), 0), 6) AS kept, round(point, 6) AS short, round(lo, 6) AS lo, round(hi, 6) AS hi, n_clusters FROM p JOIN i USING (arm)""",
    "stage_recurrence": f"""WITH sgm AS MATERIALIZED ({qs.ORACLE["segment_table"]}), wd AS MATERIALIZED ({qi.ORACLE["matched_windows"]}), {a.FRAMES_SQL},
un AS (SELECT 'segment' AS kind, recording * 1000 + start AS unit, recording, start, stop FROM sgm WHERE n_frames >= {SHORTEST} AND abstain_frac = 0 UNION ALL SELECT 'window', draw, recording, start, stop FROM wd WHERE n_frames >= {SHORTEST}),
ps AS (SELECT *, start + i * (stop - 1 - start) / {GRID - 1} AS pos FROM un, range({GRID}) r(i)), pt AS (SELECT *, floor(pos)::BIGINT AS lo, least(floor(pos)::BIGINT + 1, stop - 1) AS hi FROM ps),
vc AS (SELECT kind, unit, pt.recording % 10 AS animal, list(round(p.x + (q.x - p.x) * (pos - lo), 9) ORDER BY i) AS vec FROM pt JOIN frames p ON p.recording = pt.recording AND p.t = lo JOIN frames q ON q.recording = pt.recording AND q.t = hi GROUP BY kind, unit, pt.recording),
nn AS (SELECT x.kind, x.unit, any_value(x.animal) AS animal, round(min(list_distance(x.vec, y.vec)), 6) AS d FROM vc x JOIN vc y ON x.kind = y.kind AND x.animal <> y.animal GROUP BY x.kind, x.unit),
th AS (SELECT quantile_cont(d, 0.1) AS theta FROM nn WHERE kind = 'window')
SELECT animal, count(*) FILTER (kind = 'segment') AS segments, count(*) FILTER (kind = 'window') AS windows, round(quantile_cont(d, 0.5) FILTER (kind = 'segment'), 6) AS segment_median, round(quantile_cont(d, 0.5) FILTER (kind = 'window'), 6) AS window_median,
round(avg((d <= theta)::INT) FILTER (kind = 'segment') - avg((d <= theta)::INT) FILTER (kind = 'window'), 6) AS excess FROM nn, th GROUP BY animal""",
}
