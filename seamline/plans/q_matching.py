"""Queries on matched controls and trial plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seamline.operators import matching as mt
from seamline.operators.segments import durable
from seamline.plans.q_search import LONGEST, PREFIX
from seamline.sources import adapters as a

SEED, TRIALS = 5, 36


def segments(spark, sf_dir):
    """Pieces of recordings with duration and mean speed; every fourth is an island, the others are the pool."""
    step = F.abs(F.col("x") - F.lag("x").over(Window.partitionBy("recording").orderBy("t")))
    f = a.frames(spark, sf_dir).withColumns({"step": step, "unit": F.col("recording") * 1000 + F.floor(F.col("t") / LONGEST)})
    out = f.groupBy("unit").agg(F.first("animal").alias("animal"), F.count(F.lit(1)).alias("n_frames"), F.round(F.avg("step"), 6).alias("speed"))
    return out.where(F.col("n_frames") >= PREFIX).withColumn("island", F.pmod(F.col("unit") + F.floor(F.col("unit") / 1000), F.lit(4)) == 0)


def matched_controls(spark, sf_dir):
    """Each island's nearest control that no nearer island took, of another animal."""
    s = durable(segments(spark, sf_dir))
    out = mt.match_controls(s.where("island"), s.where("not island"), n_near=1)
    return out.select("target", "control", F.round("cost", 6).alias("cost"))


def trial_plan(spark, sf_dir):
    """Trials of both arms: three clips of three animals, the odd one's place balanced."""
    s = durable(segments(spark, sf_dir))
    out = None
    for arm in ("matched", "unmatched"):
        one = mt.plan_trials(s.where("island"), s.where("not island"), arm, TRIALS, SEED)
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (matched_controls, trial_plan)}

ORACLE = {
    # Pairs that are each other's nearest among what is left match, until none is left: the stable matching of symmetric distances.
    "matched_controls": f"""WITH RECURSIVE {a.FRAMES_SQL}, st AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY recording ORDER BY t)) AS step, recording * 1000 + t // {LONGEST} AS unit FROM frames),
seg AS (SELECT unit, any_value(animal) AS animal, count(*) AS n_frames, round(avg(step), 6) AS speed, (unit + unit // 1000) % 4 = 0 AS island FROM st GROUP BY unit HAVING count(*) >= {PREFIX}),
ft AS (SELECT unit, animal, island, ln(greatest(n_frames, 1)) AS a, ln(greatest(speed, 1e-9)) AS b FROM seg),
pairs AS MATERIALIZED (SELECT i.unit AS t, p.unit AS u, sqrt((i.a - p.a) * (i.a - p.a) + (i.b - p.b) * (i.b - p.b)) AS d FROM ft i JOIN ft p ON i.island AND NOT p.island AND i.animal <> p.animal),
m(t, u, d) USING KEY (t) AS (
  SELECT t, u, d FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d, u) AS x, row_number() OVER (PARTITION BY u ORDER BY d, t) AS y FROM pairs) WHERE x = 1 AND y = 1
  UNION ALL
  SELECT t, u, d FROM (SELECT p.*, row_number() OVER (PARTITION BY p.t ORDER BY p.d, p.u) AS x, row_number() OVER (PARTITION BY p.u ORDER BY p.d, p.t) AS y FROM pairs p
    WHERE p.t NOT IN (SELECT t FROM recurring.m) AND p.u NOT IN (SELECT u FROM recurring.m)) WHERE x = 1 AND y = 1 AND (SELECT count(*) FROM m) > 0)
SELECT t AS target, u AS control, round(d, 6) AS cost FROM m""",
}
