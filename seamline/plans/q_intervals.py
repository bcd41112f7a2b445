"""Queries on intervals: fits against drawn ones, windows of matched lengths, planted runs, chance agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.operators import annotation as an
from seamline.operators import intervals as iv
from seamline.operators import ordered as o
from seamline.operators import segments as sg
from seamline.operators.segments import durable
from seamline.plans import q_segments as qs
from seamline.sources import adapters as a

SEED, DRAWS, WINDOWS, RESTARTS = 11, 4, 500, 200
#: Frames that a planted run's edge may be off.
EDGE = 1
# The tie is decided on the scaled double, as in SQL: 0.2534375 is a little less, and its decimal digits do not tell.
R = lambda c, n=6: F.round((F.col(c) if isinstance(c, str) else c) * 10.0**n) / 10.0**n


def length_matched_fits(spark, sf_dir):
    """How often a segment's fit beats drawn intervals of its length, by recording."""
    seg = qs._segments(spark, sf_dir).where("fittable").select("recording", (F.col("start") + qs.GUARD).alias("start"), (F.col("stop") - qs.GUARD).alias("stop"))
    out = iv.length_matched_control(a.frames(spark, sf_dir), seg, "x", DRAWS, SEED)
    return out.select("recording", "n_compared", "wins", R("win_rate").alias("win_rate"), R("mean_delta", 5).alias("mean_delta"))


def matched_windows(spark, sf_dir):
    """Windows of the segments' lengths, placed anywhere in stretches without abstention."""
    f = a.frames(spark, sf_dir)
    clean = o.islands(f.withColumn("clean", F.col("code") != -1), "clean").select("recording", "start", "stop")
    return iv.matched_windows(clean, qs._segments(spark, sf_dir).select("n_frames"), WINDOWS, SEED)


def planted_run_classes(spark, sf_dir):
    """Runs of one state of three frames and more, by how the found boundaries cover them."""
    f = durable(a.frames(spark, sf_dir))
    planted = o.islands(f.withColumn("on", F.col("code") >= 2), "on").where("n_frames >= 3").select("recording", "start", "stop")
    peaks = qs._peaks(spark, sf_dir)
    out = iv.classify(planted, sg.suppress(peaks, qs.GAP), qs._segments(spark, sf_dir).select("recording", "start", "stop"), EDGE)
    n = lambda k: F.sum((F.col("found") == k).cast("long")).alias(k)
    return out.groupBy("recording").agg(*[n(k) for k in ("isolated", "no_edge", "one_edge", "merged", "split")], F.count(F.lit(1)).alias("n_instances"))


def chance_agreement(spark, sf_dir):
    """Agreement of two raters on each clip beside what as many scattered marks reach."""
    m = durable(a.marks(spark, sf_dir))
    x, y = m.where("rater = 'click'"), m.where("rater = 'view'")
    seen = sg.prf(x, y, sg.match_marks(x, y, qs.TOL))
    clips = durable(seen.join(m.groupBy("clip").agg((F.max("frame") + 1).alias("n_frames")), "clip"))
    out = clips.join(an.chance_f1(clips, qs.TOL, RESTARTS, SEED), "clip")
    return out.select("clip", "n_a", "n_b", "n_frames", R("f1").alias("f1"), R("chance_f1").alias("chance_f1"))


QUERIES = {f.__name__: f for f in (length_matched_fits, matched_windows, planted_run_classes, chance_agreement)}

_DRAW = lambda *parts: f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"
_FIT = lambda rows, keep: f"""SELECT {keep}, n, (c1 * c1 / (n * (n * n - 1) / 3) + p2 * p2 / (n * (n * n - 1) * (n * n - 4) * 4 / 5) + p3 * p3 / (n * (n * n - 1) * (n * n - 4) * (n * n - 9) * 4 / 7)) / nullif(sst, 0) AS r2
FROM (SELECT {keep}, count(*)::DOUBLE AS n, sum(c * v) AS c1, sum((3 * c * c - (n0 * n0 - 1)) * v) AS p2, sum((5 * c * c * c - c * (3 * n0 * n0 - 7)) * v) AS p3, sum(v * v) - sum(v) * sum(v) / count(*) AS sst
  FROM (SELECT {keep}, (stop - start)::DOUBLE AS n0, (2 * t - start - stop + 1)::DOUBLE AS c, round(x, 6) AS v FROM {rows} JOIN frames f ON f.recording = rec AND t >= start AND t < stop) GROUP BY {keep})"""  # noqa: E731
_SCATTER = lambda who: f"""SELECT clip, rep, unnest(list_reduce(list_prepend([]::BIGINT[], list_transform(range(0, k), lambda i: [n_frames - k + i, floor({_DRAW(f"'{SEED}'", f"'{who}'", "clip", "rep", "i")} / 4294967296.0 * (n_frames - k + i + 1))::BIGINT])),
  lambda s, e: list_append(s, CASE WHEN list_contains(s, e[2]) THEN e[1] ELSE e[2] END))) AS frame FROM (SELECT *, least({who}, n_frames) AS k FROM cl), range({RESTARTS}) r(rep) WHERE k > 0"""  # noqa: E731
_MUTUAL = "SELECT *, row_number() OVER (PARTITION BY clip, rep, fa ORDER BY d, fb) AS x, row_number() OVER (PARTITION BY clip, rep, fb ORDER BY d, fa) AS y"
ORACLE = {
    "chance_agreement": f"""WITH RECURSIVE pf AS MATERIALIZED ({qs.ORACLE["boundary_match_prf"]}), {a.MARKS_SQL},
cl AS MATERIALIZED (SELECT clip, any_value(n_a) AS n_a, any_value(n_b) AS n_b, any_value(f1) AS f1, max(frame) + 1 AS n_frames FROM pf JOIN marks USING (clip) GROUP BY clip),
sa AS MATERIALIZED ({_SCATTER("n_a")}), sb AS MATERIALIZED ({_SCATTER("n_b")}),
cand AS MATERIALIZED (SELECT clip, rep, sa.frame AS fa, sb.frame AS fb, abs(sa.frame - sb.frame) AS d FROM sa JOIN sb USING (clip, rep) WHERE abs(sa.frame - sb.frame) <= {qs.TOL}),
m(clip, rep, fa, fb) USING KEY (clip, rep, fa) AS (
  SELECT clip, rep, fa, fb FROM ({_MUTUAL} FROM cand) WHERE x = 1 AND y = 1
  UNION ALL
  SELECT clip, rep, fa, fb FROM ({_MUTUAL} FROM cand c WHERE NOT EXISTS (SELECT 1 FROM recurring.m r WHERE r.clip = c.clip AND r.rep = c.rep AND r.fa = c.fa) AND NOT EXISTS (SELECT 1 FROM recurring.m r WHERE r.clip = c.clip AND r.rep = c.rep AND r.fb = c.fb))
  WHERE x = 1 AND y = 1 AND (SELECT count(*) FROM m) > 0),
mean AS (SELECT clip, sum(2.0 * n / (least(n_a, n_frames) + least(n_b, n_frames))) / {RESTARTS} AS f FROM (SELECT clip, rep, count(*) AS n FROM m GROUP BY ALL) JOIN cl USING (clip) GROUP BY clip)
SELECT clip, n_a, n_b, n_frames, f1, round(CASE WHEN n_a = 0 AND n_b = 0 THEN 1 WHEN n_a = 0 OR n_b = 0 THEN 0 ELSE coalesce(f, 0) END::DOUBLE, 6) AS chance_f1 FROM cl LEFT JOIN mean USING (clip)""",
    "length_matched_fits": f"""WITH {qs._SEG}, sz AS (SELECT recording, count(*) AS size FROM frames GROUP BY 1),
fs AS (SELECT recording AS rec, start + {qs.GUARD} AS start, stop - {qs.GUARD} AS stop FROM st WHERE fittable), ow AS (SELECT *, 1 - (1 - r2) * (n - 1) / (n - 4) AS adj FROM ({_FIT("fs", "rec, start, stop")}) WHERE n >= 5),
dr AS (SELECT rec, start AS of_start, k, adj AS own, n::BIGINT AS len, {_DRAW(f"'{SEED}'", "rec", "start", "k")} % (size - n::BIGINT) AS off FROM ow JOIN sz ON sz.recording = rec, range({DRAWS}) r(k) WHERE size > n),
di AS (SELECT rec, of_start, k, own, off AS start, off + len AS stop FROM dr), df AS (SELECT *, 1 - (1 - r2) * (n - 1) / (n - 4) AS adj FROM ({_FIT("di", "rec, of_start, k, own, start, stop")}))
SELECT rec AS recording, count(*) AS n_compared, count(*) FILTER (own > adj) AS wins, round(avg((own > adj)::INT), 6) AS win_rate, round(avg(own - adj), 5) AS mean_delta FROM df WHERE adj IS NOT NULL AND own IS NOT NULL GROUP BY 1""",
    "matched_windows": f"""WITH {qs._SEG}, cl AS (SELECT recording, t, code <> -1 AS clean FROM frames),
cn AS (SELECT *, sum(e) OVER (PARTITION BY recording ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, coalesce(lag(clean) OVER (PARTITION BY recording ORDER BY t) <> clean, true)::INT AS e FROM cl)),
isl AS (SELECT recording, min(t) AS start, count(*) AS len FROM cn WHERE clean GROUP BY recording, g), pl AS (SELECT *, row_number() OVER (PARTITION BY len ORDER BY recording, start) - 1 AS place FROM isl),
kd AS (SELECT len, count(*) AS many FROM isl GROUP BY 1), lg AS (SELECT n_frames, row_number() OVER (ORDER BY n_frames) - 1 AS i FROM st),
dr AS (SELECT draw, floor({_DRAW(f"'{SEED}'", "'length'", "draw")} / 4294967296.0 * (SELECT count(*) FROM st))::BIGINT AS i FROM range({WINDOWS}) r(draw)), dw AS (SELECT draw, n_frames FROM dr JOIN lg USING (i)),
ft AS (SELECT n_frames, len, len - n_frames + 1 AS room, coalesce(sum((len - n_frames + 1) * many) OVER (PARTITION BY n_frames ORDER BY len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, ((len - n_frames + 1) * many)::BIGINT AS own
  FROM (SELECT DISTINCT n_frames FROM dw) JOIN kd ON len >= n_frames),
sp AS (SELECT draw, n_frames, floor({_DRAW(f"'{SEED}'", "'place'", "draw")} / 4294967296.0 * rooms)::BIGINT AS k FROM dw JOIN (SELECT n_frames, sum(own) AS rooms FROM ft GROUP BY 1) USING (n_frames))
SELECT draw, recording, start + (k - before) % room AS start, start + (k - before) % room + n_frames AS stop, n_frames FROM sp JOIN ft USING (n_frames) JOIN pl ON pl.len = ft.len AND place = (k - before) // room WHERE k >= before AND k < before + own""",
    "planted_run_classes": f"""WITH bd AS MATERIALIZED ({qs.ORACLE["nms_boundaries"]}), sgm AS MATERIALIZED ({qs.ORACLE["segment_table"]}), {a.FRAMES_SQL},
cn AS (SELECT *, sum(e) OVER (PARTITION BY recording ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT recording, t, code >= 2 AS hot, coalesce(lag(code >= 2) OVER (PARTITION BY recording ORDER BY t) <> (code >= 2), true)::INT AS e FROM frames)),
pr AS (SELECT recording, min(t) AS s, max(t) + 1 AS e FROM cn WHERE hot GROUP BY recording, g HAVING count(*) >= 3),
k AS (SELECT pr.recording, s, e, EXISTS (SELECT 1 FROM sgm WHERE sgm.recording = pr.recording AND abs(start - s) <= {EDGE} AND abs(stop - e) <= {EDGE}) AS exact, EXISTS (SELECT 1 FROM bd WHERE bd.recording = pr.recording AND abs(t - s) <= {EDGE}) AS hs,
  EXISTS (SELECT 1 FROM bd WHERE bd.recording = pr.recording AND abs(t - e) <= {EDGE}) AS he, EXISTS (SELECT 1 FROM bd WHERE bd.recording = pr.recording AND t > s + {EDGE} AND t < e - {EDGE}) AS inside FROM pr)
SELECT recording, count(*) FILTER (exact) AS isolated, count(*) FILTER (NOT exact AND NOT hs AND NOT he) AS no_edge, count(*) FILTER (NOT exact AND hs <> he) AS one_edge, count(*) FILTER (NOT exact AND hs AND he AND NOT inside) AS merged,
count(*) FILTER (NOT exact AND hs AND he AND inside) AS split, count(*) AS n_instances FROM k GROUP BY recording""",
}
