"""Queries on group statistics and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.operators import groupstats as g
from seamline.operators import ordered as o
from seamline.operators import ranking as rk
from seamline.operators import resample as rs
from seamline.operators.segments import durable
from seamline.plans.q_ordered import RUNS_SQL, runs
from seamline.sources import adapters as a

R = lambda c, n=6: F.round(c, n)
N_BOOT = 2000


def _counts(spark, sf_dir):
    return g.group_counts(a.groups(spark, sf_dir), ["recording"], "mask")


def dispersion(spark, sf_dir):
    return g.dispersion(_counts(spark, sf_dir)).select(R("observed", 9).alias("observed"), R("expected", 9).alias("expected"), "groups", R("ratio").alias("ratio"))


def lorenz_gini(spark, sf_dir):
    out = g.lorenz(_counts(spark, sf_dir), "recording")
    return out.select(*[R(c).alias(c) for c in out.columns])


def decile_profile(spark, sf_dir):
    out = g.profile(a.groups(spark, sf_dir), "value", "mask")
    return out.select("bin", "n", R("rate").alias("rate"), R("lo").alias("lo"), R("hi").alias("hi"))


def grouped_rates(spark, sf_dir):
    c = g.group_counts(a.groups(spark, sf_dir), ["animal"], "mask").withColumn("rate", F.col("k") / F.col("n"))
    ends = c.agg(F.max("rate").alias("worst"), F.min(F.when(F.col("rate") > 0, F.col("rate"))).alias("best"))
    return c.crossJoin(F.broadcast(ends)).select("animal", "k", "n", R("rate").alias("rate"), R(F.try_divide(F.col("worst"), F.col("best"))).alias("worst_to_best"))


def spearman_per_group(spark, sf_dir):
    return g.spearman(a.groups(spark, sf_dir), "animal", "value", "weight").select("animal", "n", R("rho").alias("rho"))


def partial_spearman(spark, sf_dir):
    return g.partial_spearman(a.groups(spark, sf_dir), "animal", "value", "l_discount", "weight").select("animal", "n", R("rho").alias("rho"))


def pooled_weighted_mean(spark, sf_dir):
    return g.pooled(a.groups(spark, sf_dir), ["animal"], "value", "weight").select("animal", R("mean").alias("mean"), R("weight", 2).alias("weight"))


def quartiles_within_group(spark, sf_dir):
    q = g.quartiles_within(a.frames(spark, sf_dir), ["recording"], "x", ["t"])
    return q.groupBy("recording", "quartile").agg(F.count(F.lit(1)).alias("n"), R(F.min("x")).alias("lo"), R(F.max("x")).alias("hi"))


def tv_near_far(spark, sf_dir):
    """Next-symbol distributions of long and short runs of a symbol."""
    p = o.prepare(runs(spark, sf_dir), "conditioned").where("not censored").withColumn("near", F.col("duration") == 1)
    c = p.groupBy("code", "near", "next_state").agg(F.count(F.lit(1)).alias("n"))
    return g.total_variation(c, "near", ["next_state"], ["code"]).select("code", R("tv").alias("tv"), "n_a", "n_b")


def occupancy_gini(spark, sf_dir):
    f = a.frames(spark, sf_dir)
    c = f.where("code <> -1").groupBy("code").agg(F.count(F.lit(1)).alias("k"))
    shares = f.agg(R(F.avg((F.col("code") == -1).cast("int"))).alias("abstain_share"))
    out = g.lorenz(c, "code", (0.25,)).crossJoin(F.broadcast(shares)).crossJoin(F.broadcast(c.agg(F.count(F.lit(1)).alias("live_symbols"))))
    return out.select(R("top_25").alias("top_share"), R("gini").alias("gini"), "abstain_share", "live_symbols")


def cell_occupancy(spark, sf_dir):
    """Weighted share of a label per animal, day and context."""
    c = a.cells(spark, sf_dir).groupBy("animal", "day", "context")
    return c.agg(F.sum("n_frames").alias("den"), R(F.sum(F.when(F.col("label"), F.col("n_frames")).otherwise(0)) / F.sum("n_frames")).alias("occ"))


def _deltas(spark, sf_dir):
    wide = cell_occupancy(spark, sf_dir).groupBy("animal", "day").pivot("context", ["A", "B"]).agg(F.first("occ").alias("occ"), F.first("den").alias("den"))
    wide = wide.where("A_occ is not null and B_occ is not null and A_den >= 10 and B_den >= 10")
    return wide.select("animal", "day", R(F.col("B_occ") - F.col("A_occ")).alias("delta"))


def paired_deltas(spark, sf_dir):
    return _deltas(spark, sf_dir)


def sign_flip_p(spark, sf_dir):
    d = _deltas(spark, sf_dir).withColumn("pair", F.concat_ws("-", "animal", "day"))
    return rs.sign_flip(d, "pair", "delta", n_rep=N_BOOT).select(R("obs").alias("obs"), "n", R("p").alias("p"), R("null_mean").alias("null_mean"))


def cluster_bootstrap_ci(spark, sf_dir):
    v = a.groups(spark, sf_dir).select("animal", F.col("mask").cast("double").alias("v"), "weight")
    out = rs.cluster_interval(v, "animal", "v", "weight", n_boot=N_BOOT)
    return out.select(R("point").alias("point"), R("lo").alias("lo"), R("hi").alias("hi"), "n_clusters")


def jackknife_se(spark, sf_dir):
    s = a.groups(spark, sf_dir).groupBy("animal").agg(F.sum(F.col("mask").cast("int") * F.col("weight")).alias("vw"), F.sum("weight").alias("w"))
    return rs.jackknife(s, "animal").select(R("theta").alias("theta"), R("se").alias("se"), "n_clusters")


def sampled_runs(spark, sf_dir):
    """Five runs of each animal by lowest draw: a sampling operator."""
    keyed = runs(spark, sf_dir).withColumn("key", F.concat_ws("-", "recording", "run_id"))
    return rs.subsample(keyed, "key", 5, by=("animal",)).select("animal", "recording", "run_id")


def percentile_of(spark, sf_dir):
    """Mid-rank percentile, within its recording, of the signal at each first frame of a run."""
    f = a.frames(spark, sf_dir)
    ranked = f.withColumn("pct", (g.average_rank("x", ["recording"]) - 0.5) / F.count(F.lit(1)).over(_w("recording")))
    starts = runs(spark, sf_dir).select("recording", F.col("start_t").alias("t"))
    return ranked.join(starts, ["recording", "t"]).groupBy("recording").agg(F.count(F.lit(1)).alias("n"), R(F.avg("pct")).alias("mean_pct"))


def _w(key):
    from pyspark.sql import Window

    return Window.partitionBy(key)


def duration_ks(spark, sf_dir):
    """Kolmogorov-Smirnov distance between durations of fitted and held-out runs."""
    r = runs(spark, sf_dir).where("split <> 'tune' and code <> -1")
    c = r.groupBy("duration").agg(F.sum(F.when(F.col("split") == "fit", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("split") == "report", 1).otherwise(0)).alias("b"))
    from pyspark.sql import Window

    w = Window.orderBy("duration").rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct duration
    all_ = Window.partitionBy()
    gap = F.abs(F.sum("a").over(w) / F.sum("a").over(all_) - F.sum("b").over(w) / F.sum("b").over(all_))
    return c.withColumn("gap", gap).agg(R(F.max("gap")).alias("ks"), F.sum("a").alias("n_fit"), F.sum("b").alias("n_report"))


def bimodality(spark, sf_dir):
    """Sarle's coefficient of the signal per recording, from power sums with the sample deviation."""
    f = a.frames(spark, sf_dir)
    m = f.groupBy("recording").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"), F.count(F.lit(1)).alias("n")).where("n > 3 and sd > 0")
    z = f.join(m, "recording").withColumn("z", (F.col("x") - F.col("m")) / F.col("sd"))
    k = z.groupBy("recording", "n").agg(F.avg(F.pow("z", F.lit(3))).alias("s"), F.avg(F.pow("z", F.lit(4))).alias("k"))
    n = F.col("n")
    return k.select("recording", R((F.col("s") ** 2 + 1) / (F.col("k") - 3 + 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))).alias("bc"))


def displacement_by_flag(spark, sf_dir):
    """How far a five-frame median moves the signal, by whether the frame abstains, with the concentration on flagged ones."""
    med = o.rolling_median(a.frames(spark, sf_dir).select("recording", "t", "x", "code"), ["recording"], "x", 5, "med")
    d = durable(med.select((F.col("code") == -1).alias("flagged"), F.abs(F.col("x") - F.col("med")).alias("d")))
    out = d.groupBy("flagged").agg(F.count(F.lit(1)).alias("n"), R(F.avg("d")).alias("mean"), R(F.avg((F.col("d") > 10).cast("int"))).alias("moved_10"))
    return out.join(rk.quantiles_by(d, "d", {"median": 0.5}, ["flagged"]), "flagged").select("flagged", "n", R("median").alias("median"), "mean", "moved_10")


def kinematic_shift(spark, sf_dir):
    """Speed quantiles before and after the median filter."""
    med = o.rolling_median(a.frames(spark, sf_dir).select("recording", "t", "x"), ["recording"], "x", 5, "med")
    from pyspark.sql import Window

    w = Window.partitionBy("recording").orderBy("t")
    s = durable(med.select(F.abs(F.col("x") - F.lag("x").over(w)).alias("before"), F.abs(F.col("med") - F.lag("med").over(w)).alias("after")))
    probs = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
    both = [rk.quantiles_by(s, c, {f"{c}_{n}": p for n, p in probs.items()}) for c in ("before", "after")]
    return both[0].crossJoin(F.broadcast(both[1])).select(*[R(f"{c}_{n}").alias(f"{c}_{n}") for n in probs for c in ("before", "after")])  # one row each


QUERIES = {f.__name__: f for f in (dispersion, lorenz_gini, decile_profile, grouped_rates, spearman_per_group, partial_spearman, pooled_weighted_mean, quartiles_within_group, tv_near_far, occupancy_gini, cell_occupancy, paired_deltas, sign_flip_p, cluster_bootstrap_ci, jackknife_se, sampled_runs, percentile_of, duration_ks, bimodality, displacement_by_flag, kinematic_shift)}


def _draw(*parts):
    joined = " || '|' || ".join(str(p) for p in parts)
    return f"('0x' || substr(md5({joined}), 1, 8))::BIGINT"


_LORENZ = lambda c, shares: f"""r AS (SELECT *, row_number() OVER (ORDER BY k DESC, key) AS hi, row_number() OVER (ORDER BY k, key) AS lo, count(*) OVER () AS g, sum(k) OVER () AS s FROM {c})"""
_TOP = lambda s: f"round(sum(k) FILTER (hi <= greatest(1, round_even(g * {s}, 0))) / max(s), 6)"
_GINI = "round(sum((2 * lo - g - 1) * k) / (max(g) * max(s)), 6)"
_RANK = lambda c, by="animal": f"(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2)"
_OCC = f"""{a.CELLS_SQL}, occ AS (SELECT animal, day, context, sum(n_frames) AS den, round(coalesce(sum(n_frames) FILTER (label), 0) / sum(n_frames), 6) AS occ FROM cells GROUP BY ALL)"""
_DELTA = f"{_OCC}, dl AS (SELECT x.animal, x.day, round(y.occ - x.occ, 6) AS delta FROM occ x JOIN occ y USING (animal, day) WHERE x.context = 'A' AND y.context = 'B' AND x.den >= 10 AND y.den >= 10)"
_MEDIAN = f"""{a.FRAMES_SQL}, f AS (SELECT recording, t, x, code, count(*) OVER (PARTITION BY recording) AS n FROM frames),
m AS (SELECT *, true AS own FROM f UNION ALL SELECT recording, -t, x, code, n, false FROM f WHERE n > 5 AND t BETWEEN 1 AND 2
      UNION ALL SELECT recording, 2 * (n - 1) - t, x, code, n, false FROM f WHERE n > 5 AND t BETWEEN n - 3 AND n - 2),
w AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY recording ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mm FROM m),
med AS (SELECT recording, t, x, code, CASE WHEN n > 5 THEN mm ELSE x END AS med FROM w WHERE own)"""
_Q = [(0.5, "p50"), (0.9, "p90"), (0.99, "p99"), (0.999, "p999")]

ORACLE = {
    "dispersion": f"""WITH {a.GROUPS_SQL}, c AS (SELECT recording, count(*) FILTER (mask) AS k, count(*) AS n FROM groups GROUP BY 1), p AS (SELECT sum(k) / sum(n) AS p FROM c)
SELECT round(var_samp(k / n), 9) AS observed, round(avg(p * (1 - p) / n), 9) AS expected, count(*) AS groups, round(var_samp(k / n) / avg(p * (1 - p) / n), 6) AS ratio FROM c, p""",
    "lorenz_gini": f"WITH {a.GROUPS_SQL}, c AS (SELECT recording AS key, count(*) FILTER (mask) AS k FROM groups GROUP BY 1), {_LORENZ('c', 0)} SELECT {_TOP(0.01)} AS top_1, {_TOP(0.05)} AS top_5, {_TOP(0.1)} AS top_10, {_TOP(0.25)} AS top_25, {_GINI} AS gini FROM r",
    "decile_profile": f"""WITH {a.GROUPS_SQL}, e AS (SELECT list_sort(list_distinct(quantile_cont(value, [{', '.join(str(i / 10) for i in range(11))}]))) AS edges FROM groups),
b AS (SELECT *, least(greatest(len(list_filter(edges, lambda v: v <= value)) - 1, 0), len(edges) - 2)::INT AS bin FROM groups, e)
SELECT bin, count(*) AS n, round(avg(mask::INT), 6) AS rate, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM b GROUP BY bin""",
    "grouped_rates": f"WITH {a.GROUPS_SQL}, c AS (SELECT animal, count(*) FILTER (mask) AS k, count(*) AS n FROM groups GROUP BY 1) SELECT animal, k, n, round(k / n, 6) AS rate, round(max(k / n) OVER () / min(CASE WHEN k > 0 THEN k / n END) OVER (), 6) AS worst_to_best FROM c",
    "spearman_per_group": f"WITH {a.GROUPS_SQL}, r AS (SELECT animal, value, weight, {_RANK('value')} AS x, {_RANK('weight')} AS y FROM groups) SELECT animal, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY animal HAVING count(*) >= 30",
    "partial_spearman": f"""WITH {a.GROUPS_SQL}, r AS (SELECT animal, {_RANK('value')} AS x, {_RANK('l_discount')} AS y, {_RANK('weight')} AS z FROM groups), c AS (SELECT animal, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r GROUP BY 1)
SELECT animal, n, round((xy - xz * yz) / sqrt((1 - xz**2) * (1 - yz**2)), 6) AS rho FROM c WHERE n >= 30""",
    "pooled_weighted_mean": f"WITH {a.GROUPS_SQL} SELECT animal, round(sum(value * weight) / sum(weight), 6) AS mean, round(sum(weight), 2) AS weight FROM groups GROUP BY 1",
    "quartiles_within_group": f"""WITH {a.FRAMES_SQL}, q AS (SELECT recording, x, CASE WHEN count(*) OVER (PARTITION BY recording) < 4 THEN -1 ELSE (4 * row_number() OVER (PARTITION BY recording ORDER BY x, t) - 1) // count(*) OVER (PARTITION BY recording) END::INT AS quartile FROM frames)
SELECT recording, quartile, count(*) AS n, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM q GROUP BY ALL""",
    "tv_near_far": f"""WITH {RUNS_SQL}, p AS (SELECT code, duration = 1 AS near, lead(code) OVER (PARTITION BY recording ORDER BY run_id) AS nxt FROM runs), c AS (SELECT code, nxt, count(*) FILTER (near) AS a, count(*) FILTER (NOT near) AS b FROM p WHERE code <> -1 AND nxt <> -1 GROUP BY ALL),
s AS (SELECT *, sum(a) OVER (PARTITION BY code) AS ta, sum(b) OVER (PARTITION BY code) AS tb FROM c) SELECT code, round(0.5 * sum(abs(a / ta - b / tb)), 6) AS tv, max(ta)::BIGINT AS n_a, max(tb)::BIGINT AS n_b FROM s GROUP BY code""",
    "occupancy_gini": f"""WITH {a.FRAMES_SQL}, c AS (SELECT code AS key, count(*) AS k FROM frames WHERE code <> -1 GROUP BY 1), {_LORENZ('c', 0)}
SELECT {_TOP(0.25)} AS top_share, {_GINI} AS gini, (SELECT round(avg((code = -1)::INT), 6) FROM frames) AS abstain_share, (SELECT count(*) FROM c) AS live_symbols FROM r""",
    "cell_occupancy": f"WITH {_OCC} SELECT animal, day::INT AS day, context, den, occ FROM occ",
    "paired_deltas": f"WITH {_DELTA} SELECT animal, day::INT AS day, delta FROM dl",
    "sign_flip_p": f"""WITH {_DELTA}, o AS (SELECT avg(delta) AS obs, count(*) AS n FROM dl), m AS (SELECT rep, avg(delta * CASE WHEN {_draw("2", "rep", "(animal || '-' || day)")} % 2 = 0 THEN 1 ELSE -1 END) AS m FROM dl, range({N_BOOT}) r(rep) GROUP BY rep)
SELECT round(any_value(obs), 6) AS obs, any_value(n) AS n, round((count(*) FILTER (abs(m) >= abs(obs) - 1e-12) + 1) / (count(*) + 1), 6) AS p, round(avg(m), 6) AS null_mean FROM m, o""",
    "cluster_bootstrap_ci": f"""WITH {a.GROUPS_SQL}, s AS (SELECT animal, sum(mask::INT * weight) AS vw, sum(weight) AS w, row_number() OVER (ORDER BY animal) - 1 AS i, count(*) OVER () AS g FROM groups GROUP BY animal),
m AS (SELECT rep, sum(t.vw) / sum(t.w) AS m FROM s, range({N_BOOT}) r(rep), s t WHERE t.i = {_draw("1", "rep", "s.i")} % s.g GROUP BY rep)
SELECT (SELECT round(sum(vw) / sum(w), 6) FROM s) AS point, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, (SELECT count(*) FROM s) AS n_clusters FROM m""",
    "jackknife_se": f"""WITH {a.GROUPS_SQL}, s AS (SELECT animal, sum(mask::INT * weight) AS vw, sum(weight) AS w FROM groups GROUP BY animal), j AS (SELECT ((SELECT sum(vw) FROM s) - vw) / ((SELECT sum(w) FROM s) - w) AS m FROM s)
SELECT (SELECT round(sum(vw) / sum(w), 6) FROM s) AS theta, round(sqrt((count(*) - 1) * var_pop(m)), 6) AS se, count(*) AS n_clusters FROM j""",
    "sampled_runs": f"""WITH {RUNS_SQL}, k AS (SELECT animal, recording, run_id, row_number() OVER (PARTITION BY animal ORDER BY {_draw("3", "(recording || '-' || run_id)")}, recording || '-' || run_id) AS r FROM runs) SELECT animal, recording, run_id FROM k WHERE r <= 5""",
    "percentile_of": f"""WITH {RUNS_SQL}, k AS (SELECT recording, t, ({_RANK('x', 'recording')} - 0.5) / count(*) OVER (PARTITION BY recording) AS pct FROM frames)
SELECT recording, count(*) AS n, round(avg(pct), 6) AS mean_pct FROM k JOIN (SELECT recording, start_t AS t FROM runs) USING (recording, t) GROUP BY recording""",
    "duration_ks": f"""WITH {RUNS_SQL}, c AS (SELECT duration, count(*) FILTER (split = 'fit') AS a, count(*) FILTER (split = 'report') AS b FROM runs WHERE split <> 'tune' AND code <> -1 GROUP BY 1),
k AS (SELECT a, b, abs(sum(a) OVER (ORDER BY duration) / sum(a) OVER () - sum(b) OVER (ORDER BY duration) / sum(b) OVER ()) AS gap FROM c) SELECT round(max(gap), 6) AS ks, sum(a)::BIGINT AS n_fit, sum(b)::BIGINT AS n_report FROM k""",
    "bimodality": f"""WITH {a.FRAMES_SQL}, m AS (SELECT recording, avg(x) AS m, stddev_samp(x) AS sd, count(*) AS n FROM frames GROUP BY 1 HAVING count(*) > 3 AND stddev_samp(x) > 0), k AS (SELECT recording, n, avg(((x - m) / sd)**3) AS s, avg(((x - m) / sd)**4) AS k FROM frames JOIN m USING (recording) GROUP BY ALL)
SELECT recording, round((s**2 + 1) / (k - 3 + 3 * (n - 1)**2 / ((n - 2) * (n - 3))), 6) AS bc FROM k""",
    "displacement_by_flag": f"WITH {_MEDIAN}, d AS (SELECT code = -1 AS flagged, abs(x - med) AS d FROM med) SELECT flagged, count(*) AS n, round(quantile_cont(d, 0.5), 6) AS median, round(avg(d), 6) AS mean, round(avg((d > 10)::INT), 6) AS moved_10 FROM d GROUP BY flagged",
    "kinematic_shift": f"WITH {_MEDIAN}, s AS (SELECT abs(x - lag(x) OVER w) AS before, abs(med - lag(med) OVER w) AS after FROM med WINDOW w AS (PARTITION BY recording ORDER BY t)) SELECT {', '.join(f'round(quantile_cont({c}, {p}), 6) AS {c}_{n}' for p, n in _Q for c in ('before', 'after'))} FROM s",
}
