"""Queries on event history: run lengths, transitions, hazards, held-out code length."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.operators import eventhistory as h
from seamline.operators import ordered as o
from seamline.plans.q_ordered import RUNS_SQL, runs

#: Edges of the registered queries; duration_edges() fits them to data.
EDGES = [0, 1, 2, 3, 5, 8, h.OPEN_END]
_END = str(h.OPEN_END)


def prepared(spark, sf_dir):
    return o.prepare(runs(spark, sf_dir), "conditioned")


def _shares(by):
    d = F.col("duration")
    share = lambda cond, w: F.round(F.sum(F.when(cond, w).otherwise(0)) / F.sum(w), 6)
    one = F.lit(1)
    return [
        F.count(one).alias("n"), F.sum(d).alias("total"), F.round(F.percentile(d, 0.5), 6).alias("median"), F.round(F.percentile(d, 0.75), 6).alias("p75"),
        F.round(F.percentile(d, 0.9), 6).alias("p90"), F.max(d).alias("longest"), F.round(F.avg(d), 6).alias("mean"),
        *[share(d <= b, one).alias(f"runs_le{b}") for b in (1, 3, 7)], *[share(d <= b, d).alias(f"mass_le{b}") for b in (1, 3, 7)], share(d > 7, d).alias("mass_gt7"),
    ]


def run_length_distribution(spark, sf_dir):
    return runs(spark, sf_dir).where("code <> -1").groupBy("animal").agg(*_shares("animal"))


def run_length_pooled(spark, sf_dir):
    return runs(spark, sf_dir).where("code <> -1").agg(*_shares(None))


def frame_vs_run_mass(spark, sf_dir):
    by = runs(spark, sf_dir).where("code <> -1").groupBy("code").agg(F.sum("duration").alias("frames"), F.count(F.lit(1)).alias("runs"))
    total = by.agg(F.sum("frames").alias("tf"), F.sum("runs").alias("tr"))
    out = by.crossJoin(F.broadcast(total))  # one row
    return out.select("code", F.round(F.col("frames") / F.col("tf"), 6).alias("frame_share"), F.round(F.col("runs") / F.col("tr"), 6).alias("run_share"),
                      F.round(F.abs(F.col("frames") / F.col("tf") - F.col("runs") / F.col("tr")), 6).alias("gap"))


def transition_counts(spark, sf_dir):
    return h.transition_counts(prepared(spark, sf_dir), ("split",))


def ladder_nats_per_animal(spark, sf_dir):
    """Flagship: nats per run of held-out animals under rungs 0 and 1, fitted on the others."""
    p = prepared(spark, sf_dir)
    out = h.rungs(p.where("split = 'fit'"), p.where("split = 'report'"), EDGES, 4)
    return out.groupBy("animal").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.sum("duration").alias("frames"),
        F.round(F.avg("dur_nats"), 6).alias("duration_nats"),
        F.round(F.avg("sym0"), 6).alias("rung0_nats"),
        F.round(F.avg("sym1"), 6).alias("rung1_nats"),
    )


def duration_pmf(spark, sf_dir):
    return h.duration_pmf(prepared(spark, sf_dir).where("split = 'fit'"), EDGES).select("bin", F.round("dur_nats", 6).alias("dur_nats"))


def hazard_table(spark, sf_dir):
    return h.hazard(prepared(spark, sf_dir), EDGES).select("code", "bin", "at_risk", "exits", F.round("hazard", 6).alias("hazard"))


def hazard_loglik(spark, sf_dir):
    p = prepared(spark, sf_dir)
    model = h.hazard(p.where("split = 'fit'"), EDGES)
    return h.hazard_nats(model, p.where("split = 'report'"), EDGES).groupBy("animal").agg(F.count(F.lit(1)).alias("n_runs"), F.round(F.sum("nats"), 5).alias("nats"))


def frailty_curve(spark, sf_dir):
    """Pooled hazard by bin and by the animal's split, where at least 50 exits stand behind a point."""
    p = prepared(spark, sf_dir)
    out = h.hazard(p, EDGES, ("split",))
    return out.select("split", "bin", "exits", F.when(F.col("exits") >= 50, F.round("hazard", 6)).alias("hazard"))


def fall_ratio(spark, sf_dir):
    curve = frailty_curve(spark, sf_dir).where("hazard > 0")
    ends = curve.groupBy("split").agg(F.min_by("hazard", "bin").alias("first"), F.max_by("hazard", "bin").alias("last"), F.count(F.lit(1)).alias("bins"))
    return ends.select("split", "bins", F.round(F.col("first") / F.col("last"), 6).alias("ratio"), F.round(F.log(F.col("first") / F.col("last")), 6).alias("log_fall"))


def history_context_k1(spark, sf_dir):
    return h.history(prepared(spark, sf_dir), EDGES, 1).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def history_unseen_k2(spark, sf_dir):
    """Share of held-out runs whose two-step history was never fitted."""
    keyed = h.history(prepared(spark, sf_dir), EDGES, 2)
    vocab = keyed.where("split = 'fit'").select("key").distinct().withColumn("seen", F.lit(True))
    out = keyed.where("split = 'report'").join(vocab, "key", "left")
    return out.groupBy("animal").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("seen").isNull().cast("bigint")).alias("unseen"))


def rare_edges(spark, sf_dir):
    """Rung-1 nats on the five commonest fitted edges (ties to the higher pair) and on all others."""
    p = prepared(spark, sf_dir)
    fit = p.where("split = 'fit'")
    common = h.transition_counts(fit).orderBy(F.desc("n"), F.desc("code"), F.desc("next_state")).limit(5).select("code", "next_state", F.lit(True).alias("common"))
    out = h.rungs(fit, p.where("split = 'report' and not censored"), EDGES, 4).join(F.broadcast(common), ["code", "next_state"], "left")
    return out.groupBy(F.coalesce("common", F.lit(False)).alias("common")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sym1"), 6).alias("nats"))


QUERIES = {f.__name__: f for f in (run_length_distribution, run_length_pooled, frame_vs_run_mass, transition_counts, ladder_nats_per_animal, duration_pmf, hazard_table, hazard_loglik, frailty_curve, fall_ratio, history_context_k1, history_unseen_k2, rare_edges)}

_PREP = f"{RUNS_SQL}, p0 AS (SELECT *, lead(code) OVER (PARTITION BY recording ORDER BY run_id) AS nxt FROM runs), p AS (SELECT recording, animal, split, run_id, code, duration, nullif(nxt, -1) AS next_state, nullif(nxt, -1) IS NULL AS censored FROM p0 WHERE code <> -1)"
_BIN = " + ".join(f"(duration >= {e})::INT" for e in EDGES[1:-1])
_GRID = "grid AS (SELECT * FROM (VALUES " + ", ".join(f"({b}, {EDGES[b]}::BIGINT, {EDGES[b + 1]}::BIGINT)" for b in range(len(EDGES) - 1)) + ") g(bin, lo, hi))"
_PMF = f"""{_GRID}, tot AS (SELECT count(*) AS total, max(duration) AS longest FROM p WHERE split = 'fit'),
pmf AS (SELECT bin, ln(greatest((CASE WHEN hi = {_END} THEN greatest(longest, lo + 1) ELSE hi END) - lo, 1)) - ln((coalesce(n, 0) + 1.0) / (total + {len(EDGES) - 1}.0)) AS dur_nats
  FROM grid LEFT JOIN (SELECT {_BIN} AS bin, count(*) AS n FROM p WHERE split = 'fit' GROUP BY 1) c USING (bin), tot)"""
_RUNGS = f"""{_PMF}, tc AS (SELECT code, next_state, count(*) AS n FROM p WHERE split = 'fit' AND NOT censored GROUP BY ALL),
s AS (SELECT q.*, dur_nats, CASE WHEN censored THEN 0 ELSE ln((SELECT sum(n) FROM tc) + 4.0) - ln(coalesce(m, 0) + 1.0) END AS sym0,
   CASE WHEN censored THEN 0 ELSE ln(coalesce(r, 0) + 3.0) - ln(coalesce(n, 0) + 1.0) END AS sym1
  FROM (SELECT *, {_BIN} AS bin FROM p WHERE split = 'report') q LEFT JOIN pmf USING (bin)
  LEFT JOIN (SELECT next_state, sum(n) AS m FROM tc GROUP BY 1) mm USING (next_state) LEFT JOIN (SELECT code, sum(n) AS r FROM tc GROUP BY 1) rr USING (code)
  LEFT JOIN tc USING (code, next_state))"""
_STAY = "greatest(least(duration - 1, hi) - lo, 0)"
_LEAVE = "(NOT censored AND duration - 1 >= lo AND duration - 1 < hi)"


def _hazard(by, where="true", name="hz"):
    return f"{name} AS (SELECT {by}, bin, sum({_STAY} + {_LEAVE}::INT)::BIGINT AS at_risk, count(*) FILTER ({_LEAVE}) AS exits FROM p, grid WHERE {where} GROUP BY {by}, bin HAVING sum({_STAY} + {_LEAVE}::INT) > 0)"


_AGG = ", ".join(
    ["count(*) AS n", "sum(duration)::BIGINT AS total", "round(quantile_cont(duration, 0.5), 6) AS median", "round(quantile_cont(duration, 0.75), 6) AS p75",
     "round(quantile_cont(duration, 0.9), 6) AS p90", "max(duration) AS longest", "round(avg(duration), 6) AS mean"]
    + [f"round(count(*) FILTER (duration <= {b}) / count(*), 6) AS runs_le{b}" for b in (1, 3, 7)]
    + [f"round(coalesce(sum(duration) FILTER (duration <= {b}), 0) / sum(duration), 6) AS mass_le{b}" for b in (1, 3, 7)]
    + ["round(coalesce(sum(duration) FILTER (duration > 7), 0) / sum(duration), 6) AS mass_gt7"]
)
_CURVE = f"{_PREP}, {_GRID}, {_hazard('split')}, cv AS (SELECT split, bin, exits, CASE WHEN exits >= 50 THEN round(exits / at_risk, 6) END AS hazard FROM hz)"
_ITEM = f"code || ':' || ({_BIN})"
_KEY = lambda k: "code::VARCHAR || " + " || ".join(f"'|' || coalesce(lag({_ITEM}, {i}) OVER (PARTITION BY recording ORDER BY run_id), '-')" for i in range(1, k + 1))

ORACLE = {
    "run_length_distribution": f"WITH {RUNS_SQL} SELECT animal, {_AGG} FROM runs WHERE code <> -1 GROUP BY animal",
    "run_length_pooled": f"WITH {RUNS_SQL} SELECT {_AGG} FROM runs WHERE code <> -1",
    "frame_vs_run_mass": f"""WITH {RUNS_SQL}, b AS (SELECT code, sum(duration) AS frames, count(*) AS runs FROM runs WHERE code <> -1 GROUP BY code), s AS (
  SELECT code, frames / sum(frames) OVER () AS f, runs / sum(runs) OVER () AS r FROM b) SELECT code, round(f, 6) AS frame_share, round(r, 6) AS run_share, round(abs(f - r), 6) AS gap FROM s""",
    "transition_counts": f"WITH {_PREP} SELECT split, code, next_state, count(*) AS n FROM p WHERE NOT censored GROUP BY ALL",
    "ladder_nats_per_animal": f"WITH {_PREP}, {_RUNGS} SELECT animal, count(*) AS n_runs, sum(duration)::BIGINT AS frames, round(avg(dur_nats), 6) AS duration_nats, round(avg(sym0), 6) AS rung0_nats, round(avg(sym1), 6) AS rung1_nats FROM s GROUP BY animal",
    "duration_pmf": f"WITH {_PREP}, {_PMF} SELECT bin, round(dur_nats, 6) AS dur_nats FROM pmf",
    "hazard_table": f"WITH {_PREP}, {_GRID}, {_hazard('code')} SELECT code, bin, at_risk, exits, round(exits / at_risk, 6) AS hazard FROM hz",
    "hazard_loglik": f"""WITH {_PREP}, {_GRID}, {_hazard('code', "split = 'fit'")}, l AS (
  SELECT recording, run_id, animal, {_STAY} * (ln(coalesce(at_risk, 0) + 2.0) - ln(coalesce(at_risk, 0) - coalesce(exits, 0) + 1.0))
    + CASE WHEN {_LEAVE} THEN ln(coalesce(at_risk, 0) + 2.0) - ln(coalesce(exits, 0) + 1.0) ELSE 0 END AS nats
  FROM p CROSS JOIN grid LEFT JOIN hz USING (code, bin) WHERE split = 'report' AND duration - 1 >= lo)
SELECT animal, count(DISTINCT (recording, run_id)) AS n_runs, round(sum(nats), 5) AS nats FROM l GROUP BY animal""",
    "frailty_curve": f"WITH {_CURVE} SELECT split, bin, exits, hazard FROM cv",
    "fall_ratio": f"WITH {_CURVE} SELECT split, count(*) AS bins, round(min_by(hazard, bin) / max_by(hazard, bin), 6) AS ratio, round(ln(min_by(hazard, bin) / max_by(hazard, bin)), 6) AS log_fall FROM cv WHERE hazard > 0 GROUP BY split",
    "history_context_k1": f"WITH {_PREP}, k AS (SELECT {_KEY(1)} AS key FROM p) SELECT key, count(*) AS n FROM k GROUP BY key",
    "history_unseen_k2": f"WITH {_PREP}, k AS (SELECT animal, split, {_KEY(2)} AS key FROM p) SELECT animal, count(*) AS n, count(*) FILTER (key NOT IN (SELECT key FROM k WHERE split = 'fit')) AS unseen FROM k WHERE split = 'report' GROUP BY animal",
    "rare_edges": f"""WITH {_PREP}, {_RUNGS}, common AS (SELECT code, next_state FROM tc ORDER BY n DESC, code DESC, next_state DESC LIMIT 5)
SELECT (code, next_state) IN (SELECT (code, next_state) FROM common) AS common, count(*) AS n, round(avg(sym1), 6) AS nats FROM s WHERE NOT censored GROUP BY 1""",
}
