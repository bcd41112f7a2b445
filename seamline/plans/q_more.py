"""Queries on verdicts, identifiers, models, injected errors, surrogates."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from seamline.functions import verdict as v
from seamline.operators import models as m
from seamline.operators import ranking as rk
from seamline.operators import search as se
from seamline.operators import viterbi as vt
from seamline.operators import ordered as o
from seamline.operators import resample as rs
from seamline.plans import q_eventhistory as qe
from seamline.plans import q_groupstats as qg
from seamline.plans import q_ordered as qo
from seamline.plans import q_segments as qs
from seamline.operators.segments import durable
from seamline.sources import adapters as a

R = lambda c, n=6: F.round(c, n)
RATE, SHIFT = 0.05, 200.0
PAIRS = 500


def parse_ids(spark, sf_dir):
    """Identifiers built from events, parsed back into box, day, context and date."""
    e = a.read(spark, sf_dir, "events")
    ident = F.format_string("%s_Box_%d_CFD_Day_%d_(Context_%s)_u%d", F.date_format("ts", "yyyyMMdd"), F.col("user_id") % 4, F.dayofmonth("ts"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B"), F.col("user_id"))
    part = lambda p: F.coalesce(F.nullif(F.regexp_extract(ident, p, 1), F.lit("")), F.lit("?"))
    df = e.select(part(r"_Box_(\d+)").alias("box"), part(r"_Day_(\d+)").alias("day"), part(r"\(Context_(\w+)\)").alias("context"), part(r"^(\d{8})").alias("date"))
    return df.groupBy("box", "day", "context", "date").agg(F.count(F.lit(1)).alias("n"))


def table_fingerprint(spark, sf_dir):
    """Order-free content digest of each event type's rows: row count and sum of row draws."""
    e = a.read(spark, sf_dir, "events")
    row = rs.draw(F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("props"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("digest"))


def padded_windows(spark, sf_dir):
    """Masked islands padded by two frames; those that then meet are merged."""
    isl = o.islands(qo.high(spark, sf_dir), "mask")
    isl = isl.select("recording", F.greatest(F.col("start") - 2, F.lit(0)).alias("start"), (F.col("stop") + 2).alias("stop"))
    w = Window.partitionBy("recording").orderBy("start")
    top = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = F.sum(F.when(F.col("start") <= top, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    isl = isl.withColumn("_top", top).withColumn("_n", F.when(F.col("start") <= F.col("_top"), 0).otherwise(1))
    isl = isl.withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return isl.groupBy("recording", "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g")


def verdict_run_lengths(spark, sf_dir):
    r = qo.runs(spark, sf_dir).where("code <> -1")
    again = qo.rle_self_transitions(spark, sf_dir).agg(F.sum("self_transitions").alias("self_transitions"))
    n = r.agg(F.percentile("duration", 0.5).alias("median"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(again))
    return v.read("run_lengths", n, v.RULES["run_lengths"], "n")


def verdict_alphabet(spark, sf_dir):
    occ = a.frames(spark, sf_dir).where("code <> -1").groupBy("code").agg(F.count(F.lit(1)).alias("k"))
    n = occ.agg((F.max("k") / F.sum("k")).alias("top_share"), (1 - F.count(F.lit(1)) / 4).alias("dead"), F.sum("k").alias("n"))
    return v.read("alphabet", n, v.RULES["alphabet"], "n")


def verdict_concentration(spark, sf_dir):
    return v.read("concentration", qg.dispersion(spark, sf_dir), v.RULES["concentration"], "groups", 2)


def verdict_envelope(spark, sf_dir):
    isl = o.islands(qo.high(spark, sf_dir), "mask")
    n = isl.agg(F.percentile("n_frames", 0.75).alias("p75"), (F.sum(F.when(F.col("n_frames") <= 3, F.col("n_frames")).otherwise(0)) / F.sum("n_frames")).alias("mass3"), F.count(F.lit(1)).alias("n"))
    return v.read("envelope", n, v.RULES["envelope"], "n")


def verdict_ladder(spark, sf_dir):
    nats = qe.ladder_nats_per_animal(spark, sf_dir)
    gain = nats.select("animal", (F.col("rung0_nats") - F.col("rung1_nats")).alias("gain"), F.lit(1.0).alias("w"))
    ci = rs.cluster_interval(gain, "animal", "gain", "w", n_boot=qg.N_BOOT)
    return v.read("ladder", ci, v.RULES["ladder"], "n_clusters", 2)


def verdict_rank_relation(spark, sf_dir):
    rho = qg.spearman_per_group(spark, sf_dir).withColumn("w", F.lit(1.0))
    return v.read("rank_relation", rs.cluster_interval(rho, "animal", "rho", "w", n_boot=qg.N_BOOT), v.RULES["rank_relation"], "n_clusters", 2)


def verdict_agreement(spark, sf_dir):
    n = qs.boundary_match_prf(spark, sf_dir).agg(F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("n"))
    return v.read("agreement", n, v.RULES["agreement"], "n")


def verdict_recall(spark, sf_dir):
    n = qs.candidate_recall(spark, sf_dir).agg((F.sum(F.col("recall") * F.col("n")) / F.sum("n")).alias("recall"), F.sum("n").alias("n"))
    return v.read("recall", n, v.RULES["recall"], "n")


def _centres(spark, sf_dir):
    """One centroid per animal: the mean vector."""
    b = a.bank(spark, sf_dir).select("animal", F.posexplode("vec").alias("i", "x")).groupBy("animal", "i").agg(R(F.avg("x")).alias("x"))
    return b.groupBy("animal").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("centre")).select(F.col("animal").alias("state"), "centre")


def nearest_centroid(spark, sf_dir):
    return m.assign(a.bank(spark, sf_dir), _centres(spark, sf_dir)).select("unit", "code", R("sq_error").alias("sq_error"))


def distortion(spark, sf_dir):
    """Squared error per code and share of frames that their own animal's centroid wins."""
    out = m.assign(a.bank(spark, sf_dir), _centres(spark, sf_dir))
    return out.groupBy("code").agg(F.count(F.lit(1)).alias("n"), R(F.sum("sq_error"), 5).alias("sse"), R(F.avg((F.col("code") == F.col("animal")).cast("int"))).alias("own"))


def kmeans_occupancy(spark, sf_dir):
    b = a.bank(spark, sf_dir)
    return m.assign(b, m.fit_kmeans(b, 8)).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("sq_error").alias("sse"))


def pca_variance(spark, sf_dir):
    return m.pca_variance(a.bank(spark, sf_dir), 5)


def probe_accuracy(spark, sf_dir):
    """Document features against quality labels, held out by source."""
    d = a.read(spark, sf_dir, "documents").join(a.read(spark, sf_dir, "labels"), "doc_id")
    t = F.coalesce("text", F.lit(""))
    d = d.select("quality", "source", F.log1p(F.length(t)).alias("size"), F.try_divide(F.regexp_count(t, F.lit("[#*$%&|!]")), F.length(t)).alias("marks"), F.try_divide(F.regexp_count(t, F.lit("[A-Z]")), F.length(t)).alias("caps"))
    return m.probe(d.na.fill(0.0), ["size", "marks", "caps"], "quality", "source")


def gmm_bic(spark, sf_dir):
    return m.mixture_bic_gain(a.frames(spark, sf_dir), "x", 15)


def resampled_signal(spark, sf_dir):
    return m.resample(a.frames(spark, sf_dir), 40).select("recording", F.col("i").cast("bigint").alias("i"), R("y").alias("y"))


def surrogate_moments(spark, sf_dir, kind):
    f = a.frames(spark, sf_dir)
    s = m.surrogate(f, kind).join(f.select("recording", "t", "x"), ["recording", "t"])
    return s.groupBy("recording").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.avg("y").alias("surrogate_mean"), F.stddev_pop("x").alias("sd"), F.stddev_pop("y").alias("surrogate_sd"))


def viterbi_path(spark, sf_dir):
    return vt.viterbi(a.frames(spark, sf_dir).select("recording", "t", "x"))


def high_frequency_retention(spark, sf_dir):
    med = o.rolling_median(a.frames(spark, sf_dir).select("recording", "t", "x"), ["recording"], "x", 5, "med")
    out = m.retention(med, "x", "med", 8)
    return out.select("recording", "n", R("low").alias("low"), R("high").alias("high"))


def _injected(spark, sf_dir):
    f = a.frames(spark, sf_dir).select("recording", "t", F.col("x").alias("truth"))
    u = rs.draw("inject", F.col("recording"), F.col("t")) / 2.0**32
    f = f.withColumn("hit", u < RATE)
    return f.withColumn("x", F.when(F.col("hit"), F.col("truth") + SHIFT).otherwise(F.col("truth")))


def injection_repair(spark, sf_dir):
    """Teleports at a known rate, then three arms: error left where injected (repair) and made elsewhere (damage)."""
    i = _injected(spark, sf_dir)
    med = o.rolling_median(i, ["recording"], "x", 5, "y").withColumn("arm", F.lit("median"))
    gate = o.outlier_gate(i, ["recording"], "x", 3.0, 3, "y").drop("dropped").withColumn("arm", F.lit("gate"))
    raw = i.withColumn("y", F.col("x")).withColumn("arm", F.lit("raw"))
    rows = raw.unionByName(med).unionByName(gate).withColumn("err", F.abs(F.col("y") - F.col("truth")))
    mean = lambda c: R(F.avg(F.when(c, F.col("err"))))
    return rows.groupBy("arm").agg(F.sum(F.col("hit").cast("bigint")).alias("injected"), mean(F.col("hit")).alias("left_error"), mean(~F.col("hit")).alias("damage"))


def random_pair_scale(spark, sf_dir):
    """Median distance of drawn pairs of units of different animals."""
    b = a.bank(spark, sf_dir)
    numbered = durable(rk.placed(b, ["unit"], place="i"))
    n = b.agg(F.count(F.lit(1)).alias("n"))
    p = spark.range(PAIRS).crossJoin(F.broadcast(n))
    pick = lambda s: F.pmod(rs.draw(s, F.col("id")), F.col("n")).cast("int")
    p = p.select("id", pick("a").alias("ia"), pick("b").alias("ib"))
    p = p.join(numbered.select(F.col("i").alias("ia"), F.col("vec").alias("va"), F.col("animal").alias("aa")), "ia")
    p = p.join(numbered.select(F.col("i").alias("ib"), F.col("vec").alias("vb"), F.col("animal").alias("ab")), "ib").where("aa <> ab")
    d = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return p.agg(F.count(F.lit(1)).alias("pairs"), R(F.percentile(d, 0.5)).alias("scale"))


def paired_excess(spark, sf_dir):
    """Per animal: share of units nearer than the 10% quantile of the others' distances, full space less first quarter."""
    b = a.bank(spark, sf_dir)
    near = lambda vec: se.knn(b.withColumn("vec", vec), 1).select(F.col("query").alias("unit"), "dist")
    obs, null = near(F.col("vec")), near(F.slice("vec", 1, 16))
    theta = null.agg(R(F.percentile("dist", 0.1)).alias("theta"))
    both = obs.join(null.withColumnRenamed("dist", "nd"), "unit").join(b.select("unit", "animal"), "unit").crossJoin(F.broadcast(theta))
    share = lambda c: F.avg((R(c) <= F.col("theta")).cast("int"))
    return both.groupBy("animal").agg(F.count(F.lit(1)).alias("n"), R(share("dist") - share("nd")).alias("excess"))


QUERIES = {f.__name__: f for f in (parse_ids, table_fingerprint, padded_windows, verdict_run_lengths, verdict_alphabet, verdict_concentration, verdict_envelope, verdict_ladder, verdict_rank_relation, verdict_agreement, verdict_recall, nearest_centroid, distortion, kmeans_occupancy, pca_variance, probe_accuracy, gmm_bic, resampled_signal, viterbi_path, high_frequency_retention, injection_repair, random_pair_scale, paired_excess)}
QUERIES |= {f"surrogate_{k}": functools.partial(surrogate_moments, kind=k) for k in ("white", "ou", "phase", "var")}




def _read(name, numbers, n, least=1):
    cases = " ".join(f"WHEN {c} THEN '{{}}'" for c, _, _ in v.RULES[name])
    words, whys = [w for _, w, _ in v.RULES[name]], [y for _, _, y in v.RULES[name]]
    few = f"coalesce({n}, 0) < {least}"
    return f"""WITH numbers AS ({numbers}) SELECT '{name}' AS read, CASE WHEN {few} THEN 'NOT_A_RESULT' {cases.format(*words)} ELSE 'INCONCLUSIVE' END AS verdict,
CASE WHEN {few} THEN 'fewer than {least} units' {cases.format(*whys)} ELSE 'no rule applies' END AS reason, coalesce({n}, 0)::BIGINT AS n_effective, {few} AS degenerate FROM numbers"""


def _boot(rows, value):
    """Interval of an unweighted cluster mean, with the resampler's draws; one row per animal in ``rows``."""
    d = qg._draw("1", "rep", "s.i")
    return f"""WITH s AS (SELECT {value} AS vw, row_number() OVER (ORDER BY animal) - 1 AS i, count(*) OVER () AS g FROM ({rows})),
m AS (SELECT rep, avg(t.vw) AS m FROM s, range({qg.N_BOOT}) r(rep), s t WHERE t.i = {d} % s.g GROUP BY rep)
SELECT (SELECT avg(vw) FROM s) AS point, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, (SELECT count(*) FROM s) AS n_clusters FROM m"""


_C = f"""cb AS (SELECT label AS state, i, round(avg(embedding[i]::DOUBLE), 6) AS c FROM embeddings, range(1, 65) r(i) GROUP BY ALL),
ds AS (SELECT vec_id AS unit, label AS animal, state, sum((embedding[i]::DOUBLE - c)**2) AS d FROM embeddings JOIN cb ON true GROUP BY ALL),
asn AS (SELECT unit, any_value(animal) AS animal, arg_min(state, (d, state)) AS code, min(d) AS sq_error FROM ds GROUP BY unit)"""
_MED5 = qg._MEDIAN
_INJ = f"""{a.FRAMES_SQL}, inj AS (SELECT recording, t, x AS truth, {qg._draw("'inject'", "recording", "t")} / 4294967296.0 < {RATE} AS hit FROM frames),
f AS (SELECT *, CASE WHEN hit THEN truth + {SHIFT} ELSE truth END AS x, count(*) OVER (PARTITION BY recording) AS n FROM inj),
mm AS (SELECT *, true AS own FROM f UNION ALL SELECT recording, -t, truth, hit, x, n, false FROM f WHERE n > 5 AND t BETWEEN 1 AND 2 UNION ALL SELECT recording, 2 * (n - 1) - t, truth, hit, x, n, false FROM f WHERE n > 5 AND t BETWEEN n - 3 AND n - 2),
mw AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY recording ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS y FROM mm),
d AS (SELECT recording, t, x, truth, hit, abs(x - lag(x) OVER (PARTITION BY recording ORDER BY t)) AS d FROM f),
m AS (SELECT recording, quantile_cont(d, 0.5) AS m FROM d GROUP BY recording), s AS (SELECT recording, any_value(m) AS m, quantile_cont(abs(d - m), 0.5) AS s FROM d JOIN m USING (recording) GROUP BY recording),
g AS (SELECT recording, t, x, truth, hit, coalesce(d > m + 3.0 * 1.4826 * s, false) AS flag FROM d JOIN s USING (recording)),
e AS (SELECT *, CASE WHEN lag(flag) OVER (PARTITION BY recording ORDER BY t) = flag THEN 0 ELSE 1 END AS new FROM g),
i AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM e),
j AS (SELECT recording, t, x, truth, hit, flag AND count(*) OVER (PARTITION BY recording, g) <= 3 AND min(t) OVER (PARTITION BY recording, g) > 0 AND max(t) OVER (PARTITION BY recording, g) < count(*) OVER (PARTITION BY recording) - 1 AS dropped FROM i),
h AS (SELECT *, last_value(CASE WHEN NOT dropped THEN t END IGNORE NULLS) OVER b AS pt, last_value(CASE WHEN NOT dropped THEN x END IGNORE NULLS) OVER b AS px,
             first_value(CASE WHEN NOT dropped THEN t END IGNORE NULLS) OVER q AS nt, first_value(CASE WHEN NOT dropped THEN x END IGNORE NULLS) OVER q AS nx
      FROM j WINDOW b AS (PARTITION BY recording ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY recording ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
arms AS (SELECT 'raw' AS arm, hit, abs(x - truth) AS err FROM f UNION ALL SELECT 'median', hit, abs(CASE WHEN n > 5 THEN y ELSE x END - truth) FROM mw WHERE own
  UNION ALL SELECT 'gate', hit, abs(CASE WHEN NOT dropped THEN x ELSE px + (nx - px) * (t - pt) / (nt - pt) END - truth) FROM h)"""
_ID = "strftime(ts, '%Y%m%d') || '_Box_' || (user_id % 4) || '_CFD_Day_' || day(ts) || '_(Context_' || CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END || ')_u' || user_id"
ORACLE = {
    "parse_ids": f"""WITH i AS (SELECT {_ID} AS id FROM events) SELECT regexp_extract(id, '_Box_(\\d+)', 1) AS box, regexp_extract(id, '_Day_(\\d+)', 1) AS day,
regexp_extract(id, '\\(Context_(\\w+)\\)', 1) AS context, regexp_extract(id, '^(\\d{{8}})', 1) AS date, count(*) AS n FROM i GROUP BY ALL""",
    "table_fingerprint": f"SELECT event_type, count(*) AS n, sum({qg._draw('event_id', 'user_id', 'event_type', 'props')})::BIGINT AS digest FROM events GROUP BY 1",
    "padded_windows": f"""WITH {qo.HIGH_SQL}, p AS (SELECT recording, greatest(start - 2, 0) AS start, stop + 2 AS stop FROM islands), n AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY recording ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM p),
g AS (SELECT *, sum(n) OVER (PARTITION BY recording ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM n) SELECT recording, min(start) AS start, max(stop) AS stop FROM g GROUP BY recording, g""",
    "verdict_run_lengths": _read("run_lengths", f"WITH {qo.RUNS_SQL} SELECT quantile_cont(duration, 0.5) AS median, count(*) AS n, (SELECT count(*) FROM (SELECT lag(code) OVER (PARTITION BY recording ORDER BY run_id) = code AS again FROM runs) WHERE again) AS self_transitions FROM runs WHERE code <> -1", "n"),
    "verdict_alphabet": _read("alphabet", f"WITH {a.FRAMES_SQL}, c AS (SELECT code, count(*) AS k FROM frames WHERE code <> -1 GROUP BY 1) SELECT max(k) / sum(k) AS top_share, 1 - count(*) / 4 AS dead, sum(k) AS n FROM c", "n"),
    "verdict_concentration": _read("concentration", qg.ORACLE["dispersion"], "groups", 2),
    "verdict_envelope": _read("envelope", f"WITH {qo.HIGH_SQL} SELECT quantile_cont(n_frames, 0.75) AS p75, coalesce(sum(n_frames) FILTER (n_frames <= 3), 0) / sum(n_frames) AS mass3, count(*) AS n FROM islands", "n"),
    "verdict_ladder": _read("ladder", _boot(qe.ORACLE["ladder_nats_per_animal"], "rung0_nats - rung1_nats"), "n_clusters", 2),
    "verdict_rank_relation": _read("rank_relation", _boot(qg.ORACLE["spearman_per_group"], "rho"), "n_clusters", 2),
    "verdict_agreement": _read("agreement", f"SELECT avg(f1) AS f1, count(*) AS n FROM ({qs.ORACLE['boundary_match_prf']})", "n"),
    "verdict_recall": _read("recall", f"SELECT sum(recall * n) / sum(n) AS recall, sum(n) AS n FROM ({qs.ORACLE['candidate_recall']})", "n"),
    "nearest_centroid": f"WITH {_C} SELECT unit, code, round(sq_error, 6) AS sq_error FROM asn",
    "distortion": f"WITH {_C} SELECT code, count(*) AS n, round(sum(sq_error), 5) AS sse, round(avg((code = animal)::INT), 6) AS own FROM asn GROUP BY code",
    "resampled_signal": f"""WITH {a.FRAMES_SQL}, n AS (SELECT recording, max(t) AS last FROM frames GROUP BY 1), p AS (SELECT recording, i, last, i * last / 39 AS pos, least(floor(i * last / 39), greatest(last - 1, 0))::BIGINT AS k FROM n, range(40) r(i))
SELECT p.recording, i, round(l.x + (h.x - l.x) * (pos - k), 6) AS y FROM p JOIN frames l ON l.recording = p.recording AND l.t = k JOIN frames h ON h.recording = p.recording AND h.t = least(k + 1, last)""",
    "injection_repair": f"WITH {_INJ} SELECT arm, count(*) FILTER (hit) AS injected, round(avg(err) FILTER (hit), 6) AS left_error, round(avg(err) FILTER (NOT hit), 6) AS damage FROM arms GROUP BY arm",
    "high_frequency_retention": f"""WITH {_MED5}, nn AS (SELECT recording, count(*) AS n, avg(x) AS mx, avg(med) AS mm FROM med GROUP BY 1),
ft AS (SELECT recording, any_value(n) AS n, k, sum((x - mx) * cos(2 * pi() * k * t / n))**2 + sum((x - mx) * sin(2 * pi() * k * t / n))**2 AS pb, sum((med - mm) * cos(2 * pi() * k * t / n))**2 + sum((med - mm) * sin(2 * pi() * k * t / n))**2 AS pa
  FROM med JOIN nn USING (recording) JOIN range(1, 100000) r(k) ON k <= n // 2 GROUP BY recording, k)
SELECT recording, any_value(n) AS n, round(sum(pa) FILTER (k < 8) / sum(pb) FILTER (k < 8), 6) AS low, round(sum(pa) FILTER (k >= 8) / sum(pb) FILTER (k >= 8), 6) AS high FROM ft GROUP BY recording""",
    # One step a frame, forwards for costs, then backwards from the cheapest end.
    "viterbi_path": f"""WITH RECURSIVE {a.FRAMES_SQL}, cd AS (SELECT recording, t, [x, {", ".join(f"coalesce(lag(x, {b}) OVER w, first_value(x) OVER w)" for b in (1, 2, 3))}] AS c, count(*) OVER (PARTITION BY recording) AS n FROM frames WINDOW w AS (PARTITION BY recording ORDER BY t)),
go(recording, t, n, c, cost, back) AS (SELECT recording, t, n, c, [0.0, 8.0, 8.0, 8.0]::DOUBLE[], [1, 1, 1, 1] FROM cd WHERE t = 0
  UNION ALL SELECT recording, t, n, c, list_transform(moves, lambda m, b: list_min(m) + CASE WHEN b = 1 THEN 0.0 ELSE 8.0 END), list_transform(moves, lambda m: list_position(m, list_min(m)))
  FROM (SELECT cd.recording, cd.t, cd.n, cd.c, list_transform(cd.c, lambda v: list_transform(range(1, 5), lambda p: ((v - go.c[p]) / 30.0) * ((v - go.c[p]) / 30.0) + go.cost[p])) AS moves FROM go JOIN cd ON cd.recording = go.recording AND cd.t = go.t + 1)),
bk(recording, t, s) AS (SELECT recording, t, list_position(cost, list_min(cost)) FROM go WHERE t = n - 1 UNION ALL SELECT go.recording, go.t - 1, go.back[bk.s] FROM bk JOIN go ON go.recording = bk.recording AND go.t = bk.t WHERE go.t > 0)
SELECT bk.recording, bk.t, go.c[s] AS y, s > 1 AS replaced FROM bk JOIN go ON go.recording = bk.recording AND go.t = bk.t""",
    "random_pair_scale": f"""WITH b AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings), p AS (SELECT id, {qg._draw("'a'", "id")} % (SELECT count(*) FROM embeddings) AS ia, {qg._draw("'b'", "id")} % (SELECT count(*) FROM embeddings) AS ib FROM range({PAIRS}) r(id))
SELECT count(*) AS pairs, round(quantile_cont(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 0.5), 6) AS scale FROM p JOIN b x ON x.i = ia JOIN b y ON y.i = ib WHERE x.label <> y.label""",
    "paired_excess": f"""WITH {qs._KNN(1)}, {qs._KNN(1, 16, 'nl')}, tt AS (SELECT round(quantile_cont(dist, 0.1), 6) AS theta FROM nl)
SELECT nn.animal, count(*) AS n, round(avg((round(nn.dist, 6) <= theta)::INT) - avg((round(nl.dist, 6) <= theta)::INT), 6) AS excess FROM nn JOIN nl USING (query), tt GROUP BY nn.animal""",
}
