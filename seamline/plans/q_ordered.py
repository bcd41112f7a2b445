"""Queries on runs and ordered signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators import ordered as o
from seamline.sources import adapters as a

RUNS_SQL = (
    a.FRAMES_SQL
    + """, marked AS (
  SELECT *, CASE WHEN lag(code) OVER (PARTITION BY recording ORDER BY t) = code THEN 0 ELSE 1 END AS new FROM frames
), numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY t ROWS UNBOUNDED PRECEDING) AS run_id FROM marked
), runs AS (
  SELECT recording, animal, split, run_id::BIGINT AS run_id, min(code) AS code, min(t) AS start_t, max(t) + 1 AS end_t, count(*) AS duration
  FROM numbered GROUP BY recording, animal, split, run_id
)"""
)
#: Frames over the 90th percentile of their recording, and the islands of such frames.
HIGH_SQL = (
    a.FRAMES_SQL
    + """, high AS (
  SELECT *, x > quantile_cont(x, 0.9) OVER (PARTITION BY recording) AS mask FROM frames
), hm AS (SELECT *, CASE WHEN lag(mask) OVER (PARTITION BY recording ORDER BY t) = mask THEN 0 ELSE 1 END AS new FROM high
), hn AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM hm
), islands AS (SELECT recording, min(t) AS start, max(t) + 1 AS stop, count(*) AS n_frames FROM hn WHERE mask GROUP BY recording, g)"""
)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.encode(a.frames(spark, sf_dir), ["animal", "split"])


def high(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = a.frames(spark, sf_dir)
    top = f.groupBy("recording").agg(F.percentile("x", 0.9).alias("top"))
    return f.join(top, "recording").withColumn("mask", F.col("x") > F.col("top"))


def rle_runs(spark, sf_dir):
    return runs(spark, sf_dir).select("recording", "run_id", "code", "start_t", "end_t", "duration")


def rle_self_transitions(spark, sf_dir):
    flagged = runs(spark, sf_dir)
    flagged = flagged.withColumn("again", o.self_transitions(flagged))
    return flagged.groupBy("animal").agg(F.sum(F.col("again").cast("bigint")).alias("self_transitions"), F.sum("duration").alias("frames"), F.count(F.lit(1)).alias("runs"))


def sequences_split_on_abstain(spark, sf_dir):
    return o.sequences(runs(spark, sf_dir)).select("recording", "seq", F.array_join(F.transform("codes", lambda c: c.cast("string")), " ").alias("codes"), "n_runs")


def prepare_conditioned(spark, sf_dir):
    return o.prepare(runs(spark, sf_dir), "conditioned").select("recording", "run_id", "code", "duration", "next_state", "censored")


def prepare_symbol(spark, sf_dir):
    return o.prepare(runs(spark, sf_dir), "symbol").select("recording", "run_id", "code", "duration", "next_state", "censored")


def held_interpolation(spark, sf_dir):
    kp = a.keypoints(a.pose(spark, sf_dir))
    out = o.held(kp, ["recording", "k"], "x", "missing", "held_x")
    return out.select("recording", "t", "k", F.round("held_x", 6).alias("held_x"))


def rolling_median_reflect(spark, sf_dir):
    out = o.rolling_median(a.frames(spark, sf_dir).select("recording", "t", "x"), ["recording"], "x", 5, "med")
    return out.select("recording", "t", F.round("med", 6).alias("med"))


def savgol_interior(spark, sf_dir):
    out = o.savgol_interior(a.frames(spark, sf_dir), ["recording"], "x", 7, "smooth")
    return out.select("recording", "t", F.round("smooth", 6).alias("smooth"))


def outlier_gate_mad(spark, sf_dir):
    out = o.outlier_gate(a.frames(spark, sf_dir).select("recording", "t", "x"), ["recording"], "x", 1.5, 3, "gated")
    return out.select("recording", "t", "dropped", F.round("gated", 6).alias("gated"))


def mask_islands(spark, sf_dir):
    return o.islands(high(spark, sf_dir), "mask")


def envelope_runs(spark, sf_dir):
    return o.envelope(o.islands(high(spark, sf_dir), "mask"), max_correct=1, merge_gap=5)


def donor_asof(spark, sf_dir):
    return o.donors(high(spark, sf_dir), "mask").where("mask").select("recording", "t", "donor")


QUERIES = {f.__name__: f for f in (rle_runs, rle_self_transitions, sequences_split_on_abstain, prepare_conditioned, prepare_symbol, held_interpolation, rolling_median_reflect, savgol_interior, outlier_gate_mad, mask_islands, envelope_runs, donor_asof)}

_PREP = "lead(code) OVER (PARTITION BY recording ORDER BY run_id)"
_SG = [(-3, -2), (-2, 3), (-1, 6), (0, 7), (1, 6), (2, 3), (3, -2)]  # 21ths: quadratic fit over seven points
ORACLE = {
    "rle_runs": f"WITH {RUNS_SQL} SELECT recording, run_id, code, start_t, end_t, duration FROM runs",
    "rle_self_transitions": f"""WITH {RUNS_SQL}, s AS (SELECT *, lag(code) OVER (PARTITION BY recording ORDER BY run_id) = code AS again FROM runs)
SELECT animal, count(*) FILTER (again) AS self_transitions, sum(duration)::BIGINT AS frames, count(*) AS runs FROM s GROUP BY animal""",
    "sequences_split_on_abstain": f"""WITH {RUNS_SQL}, s AS (
  SELECT *, sum(CASE WHEN code = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY recording ORDER BY run_id ROWS UNBOUNDED PRECEDING) AS seq FROM runs)
SELECT recording, seq::BIGINT AS seq, string_agg(code::VARCHAR, ' ' ORDER BY run_id) AS codes, count(*) AS n_runs FROM s WHERE code <> -1 GROUP BY recording, seq""",
    "prepare_conditioned": f"""WITH {RUNS_SQL}, p AS (SELECT *, {_PREP} AS nxt FROM runs)
SELECT recording, run_id, code, duration, nullif(nxt, -1) AS next_state, nullif(nxt, -1) IS NULL AS censored FROM p WHERE code <> -1""",
    "prepare_symbol": f"""WITH {RUNS_SQL}, p AS (SELECT *, {_PREP} AS nxt FROM runs)
SELECT recording, run_id, CASE WHEN code = -1 THEN 4 ELSE code END AS code, duration, CASE WHEN nxt = -1 THEN 4 ELSE nxt END AS next_state, nxt IS NULL AS censored FROM p""",
    "held_interpolation": f"""WITH {a.POSE_SQL}, h AS (
  SELECT *, last_value(CASE WHEN NOT missing THEN t END IGNORE NULLS) OVER b AS pt, last_value(CASE WHEN NOT missing THEN x END IGNORE NULLS) OVER b AS px,
            first_value(CASE WHEN NOT missing THEN t END IGNORE NULLS) OVER f AS nt, first_value(CASE WHEN NOT missing THEN x END IGNORE NULLS) OVER f AS nx
  FROM kp WINDOW b AS (PARTITION BY recording, k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 f AS (PARTITION BY recording, k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT recording, t, k, round(CASE WHEN NOT missing THEN x WHEN pt IS NOT NULL AND nt IS NOT NULL THEN px + (nx - px) * (t - pt) / (nt - pt)
  WHEN pt IS NOT NULL THEN px WHEN nt IS NOT NULL THEN nx ELSE x END, 6) AS held_x FROM h""",
    "rolling_median_reflect": f"""WITH {a.FRAMES_SQL}, f AS (SELECT recording, t, x, count(*) OVER (PARTITION BY recording) AS n FROM frames),
m AS (SELECT *, true AS own FROM f UNION ALL SELECT recording, -t, x, n, false FROM f WHERE n > 5 AND t BETWEEN 1 AND 2
      UNION ALL SELECT recording, 2 * (n - 1) - t, x, n, false FROM f WHERE n > 5 AND t BETWEEN n - 3 AND n - 2),
w AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY recording ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS med FROM m)
SELECT recording, t, round(CASE WHEN n > 5 THEN med ELSE x END, 6) AS med FROM w WHERE own""",
    "savgol_interior": f"""WITH {a.FRAMES_SQL} SELECT recording, t, round(({' + '.join(f"{w} * lead(x, {i}) OVER o" if i >= 0 else f"{w} * lag(x, {-i}) OVER o" for i, w in _SG)}) / 21.0, 6) AS smooth
FROM frames WINDOW o AS (PARTITION BY recording ORDER BY t)""",
    "outlier_gate_mad": f"""WITH {a.FRAMES_SQL}, d AS (SELECT recording, t, x, abs(x - lag(x) OVER (PARTITION BY recording ORDER BY t)) AS d FROM frames),
m AS (SELECT recording, quantile_cont(d, 0.5) AS m FROM d GROUP BY recording),
s AS (SELECT recording, any_value(m) AS m, quantile_cont(abs(d - m), 0.5) AS s FROM d JOIN m USING (recording) GROUP BY recording),
g AS (SELECT recording, t, x, coalesce(d > m + 1.5 * 1.4826 * s, false) AS flag FROM d JOIN s USING (recording)),
e AS (SELECT *, CASE WHEN lag(flag) OVER (PARTITION BY recording ORDER BY t) = flag THEN 0 ELSE 1 END AS new FROM g),
i AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM e),
j AS (SELECT recording, t, x, flag AND count(*) OVER (PARTITION BY recording, g) <= 3 AND min(t) OVER (PARTITION BY recording, g) > 0
        AND max(t) OVER (PARTITION BY recording, g) < count(*) OVER (PARTITION BY recording) - 1 AS dropped FROM i),
h AS (SELECT *, last_value(CASE WHEN NOT dropped THEN t END IGNORE NULLS) OVER b AS pt, last_value(CASE WHEN NOT dropped THEN x END IGNORE NULLS) OVER b AS px,
             first_value(CASE WHEN NOT dropped THEN t END IGNORE NULLS) OVER f AS nt, first_value(CASE WHEN NOT dropped THEN x END IGNORE NULLS) OVER f AS nx
      FROM j WINDOW b AS (PARTITION BY recording ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY recording ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT recording, t, dropped, round(CASE WHEN NOT dropped THEN x ELSE px + (nx - px) * (t - pt) / (nt - pt) END, 6) AS gated FROM h""",
    "mask_islands": f"WITH {HIGH_SQL} SELECT recording, start, stop, n_frames FROM islands",
    "envelope_runs": f"""WITH {HIGH_SQL}, l AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY recording ORDER BY start) < 5 THEN 0 ELSE 1 END AS new FROM islands WHERE n_frames > 1),
k AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT recording, 'correct' AS action, start, stop FROM islands WHERE n_frames <= 1 UNION ALL SELECT recording, 'abstain', min(start), max(stop) FROM k GROUP BY recording, g""",
    "donor_asof": f"""WITH {HIGH_SQL}, d AS (
  SELECT recording, t, mask, max(CASE WHEN NOT mask THEN t END) OVER (PARTITION BY recording ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
         min(CASE WHEN NOT mask THEN t END) OVER (PARTITION BY recording ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM high)
SELECT recording, t, CASE WHEN p IS NULL THEN n WHEN n IS NULL THEN p WHEN t - p <= n - t THEN p ELSE n END AS donor FROM d WHERE mask""",
}
