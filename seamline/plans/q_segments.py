"""Queries on change points, segments, marks, neighbours and threshold graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seamline.operators import neighbours as nb
from seamline.operators import search as se
from seamline.operators import segments as s
from seamline.sources import adapters as a

R = lambda c, n=6: F.round(c, n)
H, K_MAD, GAP, GUARD, LEAST = 3, 0.5, 4, 1, 3
TOL = 6


def _d(spark, sf_dir):
    # Rounded, so that equal heights are equal in every engine.
    return s.discontinuity(a.frames(spark, sf_dir), ["x"], H).withColumn("d", R("d"))


def discontinuity(spark, sf_dir):
    return _d(spark, sf_dir).select("recording", "t", "d")


def mad_threshold(spark, sf_dir):
    return s.mad_threshold(_d(spark, sf_dir), K_MAD).select("recording", R("threshold").alias("threshold"))


def _peaks(spark, sf_dir):
    d = _d(spark, sf_dir)
    return s.local_maxima(d, s.mad_threshold(d, K_MAD).withColumn("threshold", R("threshold")))


def local_maxima(spark, sf_dir):
    return _peaks(spark, sf_dir)


def nms_boundaries(spark, sf_dir):
    return s.suppress(_peaks(spark, sf_dir), GAP).select("recording", "t")


def _segments(spark, sf_dir):
    return s.segment_table(a.frames(spark, sf_dir), _peaks(spark, sf_dir), GUARD, LEAST)


def segment_table(spark, sf_dir):
    return _segments(spark, sf_dir).select("recording", "start", "stop", "n_frames", R("abstain_frac").alias("abstain_frac"), R("mean_x").alias("mean_x"), "fittable")


def selectable_segments(spark, sf_dir):
    return s.selectable(_segments(spark, sf_dir)).select("recording", "start", "stop", "n_frames")


def segment_rates_range_join(spark, sf_dir):
    """Mean of a mask inside ten-frame segments, by bucketed interval join."""
    f = a.frames(spark, sf_dir)
    seg = f.where("t % 10 = 0").select("recording", F.col("t").alias("lo"), (F.col("t") + 10).alias("hi"))
    size = 10
    seg = seg.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    hit = f.withColumn("b", F.floor(F.col("t") / size)).join(seg, ["recording", "b"]).where("t >= lo and t < hi")
    return hit.groupBy("recording", "lo", "hi").agg(R(F.avg((F.col("code") == 2).cast("int"))).alias("rate"), F.count(F.lit(1)).alias("n"))


def boundary_match_prf(spark, sf_dir):
    m = a.marks(spark, sf_dir)
    x, y = m.where("rater = 'click'"), m.where("rater = 'view'")
    out = s.prf(x, y, s.match_marks(x, y, TOL))
    return out.select("clip", "n_a", "n_b", "n_m", R("precision").alias("precision"), R("recall").alias("recall"), R("f1").alias("f1"))


def knn_cross_group(spark, sf_dir):
    out = se.knn(a.bank(spark, sf_dir), 5)
    return out.select("query", F.col("rank").cast("bigint").alias("rank"), "neighbour", R("dist").alias("dist"))


def _nearest(spark, sf_dir):
    return se.knn(a.bank(spark, sf_dir), 5)


def clump_components(spark, sf_dir):
    """Components of nearest-neighbour edges under the 10% quantile of first-neighbour distances."""
    nn = _nearest(spark, sf_dir)
    theta = nn.where("rank = 1").agg(R(F.percentile("dist", 0.1)).alias("theta"))
    edges = nn.crossJoin(F.broadcast(theta)).where(R("dist") < F.col("theta")).select(F.col("query").alias("a"), F.col("neighbour").alias("b"))
    return nb.components(edges)


def participation(spark, sf_dir):
    """Per component: size, animals and the largest animal's share."""
    c = clump_components(spark, sf_dir).join(a.bank(spark, sf_dir).select("unit", "animal"), "unit")
    per = c.groupBy("component", "animal").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("component").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("animals"), R(F.max("n") / F.sum("n")).alias("top_share"))


def candidate_recall(spark, sf_dir):
    """Share of true five nearest among the 20 nearest by the vector's first quarter."""
    b = a.bank(spark, sf_dir)
    rough = se.knn(b.withColumn("vec", F.slice("vec", 1, 16)), 20).select("query", "neighbour", F.lit(1).alias("hit"))
    out = se.knn(b, 5).join(rough, ["query", "neighbour"], "left").join(b.select(F.col("unit").alias("query"), "animal"), "query")
    return out.groupBy("animal").agg(F.count(F.lit(1)).alias("n"), R(F.avg(F.coalesce("hit", F.lit(0)))).alias("recall"))


def sequence_distances(spark, sf_dir):
    """Open-end and union-end distances between each recording's signal and the next recording's."""
    f = a.frames(spark, sf_dir).groupBy("recording").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("s")).select("recording", F.transform("s", lambda z: z["x"]).alias("v"))
    nxt = f.select((F.col("recording") - 1).alias("recording"), F.col("v").alias("w"))
    both = f.join(nxt, "recording")
    return both.select("recording", R(nb.open_end(F.col("v"), F.col("w"))).alias("open_end"), R(nb.union_end(F.col("v"), F.col("w"))).alias("union_end"))


QUERIES = {f.__name__: f for f in (discontinuity, mad_threshold, local_maxima, nms_boundaries, segment_table, selectable_segments, segment_rates_range_join, boundary_match_prf, knn_cross_group, clump_components, participation, candidate_recall, sequence_distances)}

_W = s.curvature_weights(H)
_RIGHT = " + ".join(f"{v!r} * lead(x, {i}) OVER w" for i, v in enumerate(_W))
_LEFT = " + ".join(f"{v!r} * lag(x, {i}) OVER w" for i, v in enumerate(_W))
_D = f"{a.FRAMES_SQL}, d AS (SELECT recording, t, code, x, round(coalesce(abs(({_RIGHT}) - ({_LEFT})), 0), 6) AS d FROM frames WINDOW w AS (PARTITION BY recording ORDER BY t))"
_T = f"{_D}, md AS (SELECT recording, quantile_cont(d, 0.5) AS med FROM d GROUP BY 1), th AS (SELECT recording, any_value(med) + {K_MAD} * 1.4826 * (quantile_cont(abs(d - med), 0.5) + 1e-12) AS threshold FROM d JOIN md USING (recording) GROUP BY 1)"
_P = f"""{_T}, pk AS (SELECT recording, t, d FROM (SELECT *, lag(d) OVER w AS pa, lead(d) OVER w AS pb FROM d WINDOW w AS (PARTITION BY recording ORDER BY t)) JOIN th USING (recording) WHERE d > round(threshold, 6) AND d >= pa AND d > pb)"""
_SEG = f"""{_P}, ab AS (SELECT *, code = -1 AS abstains FROM d), eg AS (SELECT recording, t FROM (SELECT recording, t, coalesce(lag(abstains) OVER w <> abstains, true) AS e FROM ab WINDOW w AS (PARTITION BY recording ORDER BY t)) WHERE e),
ct AS (SELECT recording, t FROM eg UNION SELECT recording, t FROM pk UNION SELECT recording, max(t) + 1 FROM d GROUP BY 1),
sg AS (SELECT * FROM (SELECT recording, t AS start, lead(t) OVER (PARTITION BY recording ORDER BY t) AS stop FROM ct) WHERE stop IS NOT NULL),
st AS (SELECT sg.recording, start, stop, stop - start AS n_frames, avg(abstains::INT) AS abstain_frac, avg(x) AS mean_x, stop - start >= {LEAST + 2 * GUARD} AS fittable FROM sg JOIN ab ON ab.recording = sg.recording AND t >= start AND t < stop GROUP BY ALL)"""
_KNN = lambda k, n=64, name="nn": f"""{name} AS (SELECT * FROM (SELECT q.vec_id AS query, b.vec_id AS neighbour, q.label AS animal, list_distance(q.embedding[1:{n}]::DOUBLE[], b.embedding[1:{n}]::DOUBLE[]) AS dist,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding[1:{n}]::DOUBLE[], b.embedding[1:{n}]::DOUBLE[]), b.vec_id) AS rank FROM embeddings q JOIN embeddings b ON q.label <> b.label) WHERE rank <= {k})"""  # noqa: E731
_COMP = f"""{_KNN(5)}, tt AS (SELECT round(quantile_cont(dist, 0.1), 6) AS theta FROM nn WHERE rank = 1), ed AS (SELECT query AS a, neighbour AS b FROM nn, tt WHERE round(dist, 6) < theta UNION SELECT neighbour, query FROM nn, tt WHERE round(dist, 6) < theta),
rc(unit, seen) AS (SELECT DISTINCT a, a FROM ed UNION SELECT rc.unit, ed.b FROM rc JOIN ed ON rc.seen = ed.a), cp AS (SELECT unit, min(seen) AS component FROM rc GROUP BY unit)"""
ORACLE = {
    "discontinuity": f"WITH {_D} SELECT recording, t, d FROM d",
    "mad_threshold": f"WITH {_T} SELECT recording, round(threshold, 6) AS threshold FROM th",
    "local_maxima": f"WITH {_P} SELECT recording, t, d FROM pk",
    # Tallest first: a peak stays unless a taller one within the gap stays; walked in order of height within a recording.
    "nms_boundaries": f"""WITH RECURSIVE {_P}, rk AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY d DESC, t) AS r FROM pk),
go(recording, r, kept) AS (SELECT recording, 1::BIGINT, [t] FROM rk WHERE r = 1
  UNION ALL SELECT go.recording, rk.r, CASE WHEN len(list_filter(go.kept, lambda k: abs(k - rk.t) < {GAP})) = 0 THEN list_append(go.kept, rk.t) ELSE go.kept END FROM go JOIN rk ON rk.recording = go.recording AND rk.r = go.r + 1)
SELECT recording, unnest(kept) AS t FROM (SELECT recording, arg_max(kept, r) AS kept FROM go GROUP BY recording)""",
    "segment_table": f"WITH {_SEG} SELECT recording, start, stop, n_frames, round(abstain_frac, 6) AS abstain_frac, round(mean_x, 6) AS mean_x, fittable FROM st",
    "selectable_segments": f"""WITH {_SEG}, nr AS (SELECT *, coalesce(lag(abstain_frac) OVER w, 1) > 0 OR coalesce(lead(abstain_frac) OVER w, 1) > 0 AS near FROM st WINDOW w AS (PARTITION BY recording ORDER BY start))
SELECT recording, start, stop, n_frames FROM nr WHERE fittable AND abstain_frac = 0 AND NOT near""",
    "segment_rates_range_join": f"WITH {a.FRAMES_SQL} SELECT s.recording, s.t AS lo, s.t + 10 AS hi, round(avg((f.code = 2)::INT), 6) AS rate, count(*) AS n FROM frames s JOIN frames f ON f.recording = s.recording AND f.t >= s.t AND f.t < s.t + 10 WHERE s.t % 10 = 0 GROUP BY ALL",
    "boundary_match_prf": f"""WITH RECURSIVE {a.MARKS_SQL}, ca AS (SELECT x.clip, x.frame AS fa, y.frame AS fb, row_number() OVER (PARTITION BY x.clip ORDER BY abs(x.frame - y.frame), x.frame, y.frame) AS r
  FROM marks x JOIN marks y ON x.clip = y.clip AND abs(x.frame - y.frame) <= {TOL} WHERE x.rater = 'click' AND y.rater = 'view'),
go(clip, r, ua, ub) AS (SELECT clip, 1::BIGINT, [fa], [fb] FROM ca WHERE r = 1
  UNION ALL SELECT go.clip, ca.r, CASE WHEN list_contains(ua, fa) OR list_contains(ub, fb) THEN ua ELSE list_append(ua, fa) END, CASE WHEN list_contains(ua, fa) OR list_contains(ub, fb) THEN ub ELSE list_append(ub, fb) END
  FROM go JOIN ca ON ca.clip = go.clip AND ca.r = go.r + 1), mt AS (SELECT clip, max(len(ua)) AS n_m FROM go GROUP BY clip),
nn AS (SELECT clip, count(*) FILTER (rater = 'click') AS n_a, count(*) FILTER (rater = 'view') AS n_b FROM marks GROUP BY clip)
SELECT clip, n_a, n_b, coalesce(n_m, 0)::BIGINT AS n_m, round(coalesce(coalesce(n_m, 0) / nullif(n_b, 0), 0), 6) AS precision, round(coalesce(coalesce(n_m, 0) / nullif(n_a, 0), 0), 6) AS recall, round(2 * coalesce(n_m, 0) / (n_a + n_b), 6) AS f1 FROM nn LEFT JOIN mt USING (clip)""",
    "knn_cross_group": f"WITH {_KNN(5)} SELECT query, rank, neighbour, round(dist, 6) AS dist FROM nn",
    "clump_components": f"WITH RECURSIVE {_COMP} SELECT unit, component FROM cp",
    "participation": f"WITH RECURSIVE {_COMP}, pa AS (SELECT component, label, count(*) AS n FROM cp JOIN embeddings ON unit = vec_id GROUP BY ALL) SELECT component, sum(n)::BIGINT AS size, count(*) AS animals, round(max(n) / sum(n), 6) AS top_share FROM pa GROUP BY component",
    "candidate_recall": f"WITH {_KNN(5)}, {_KNN(20, 16, 'rf')} SELECT nn.animal, count(*) AS n, round(avg((rf.query IS NOT NULL)::INT), 6) AS recall FROM nn LEFT JOIN rf USING (query, neighbour) GROUP BY nn.animal",
    "sequence_distances": f"""WITH {a.FRAMES_SQL}, l AS (SELECT recording, max(t) + 1 AS n, arg_max(x, t) AS last FROM frames GROUP BY 1), u AS (
  SELECT a.recording, g.t, coalesce(p.x, a.last) AS xa, coalesce(q.x, b.last) AS xb, g.t < least(a.n, b.n) AS shared FROM l a JOIN l b ON b.recording = a.recording + 1 JOIN range(100000) g(t) ON g.t < greatest(a.n, b.n)
  LEFT JOIN frames p ON p.recording = a.recording AND p.t = g.t LEFT JOIN frames q ON q.recording = b.recording AND q.t = g.t)
SELECT recording, round(sqrt(avg((xa - xb)**2) FILTER (shared)), 6) AS open_end, round(sqrt(avg((xa - xb)**2)), 6) AS union_end FROM u GROUP BY recording""",
}
