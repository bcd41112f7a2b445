"""The full ladder: code length of held-out runs under all rungs, both ways of treating abstention."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.operators import ladder as l
from seamline.operators import ordered as o
from seamline.operators.segments import durable
from seamline.plans.q_eventhistory import EDGES
from seamline.plans.q_ordered import RUNS_SQL, runs

FPS = 30.0
KS = (0, 1, 2)
#: Abstention as a state of its own, or cut out with the run before it censored; and the number of states.
MODES = {"conditioned": 4, "symbol": 5}


def _scored(spark, sf_dir, mode):
    p = durable(o.prepare(runs(spark, sf_dir), mode).select(*l.RUN, "animal", "split", "code", "duration", "next_state", "censored"))
    fit, report = p.where("split = 'fit'"), p.where("split = 'report'")
    nats, params = l.score(fit, report, EDGES, MODES[mode], KS)
    return nats.join(report.select(*l.RUN, "animal", "duration"), list(l.RUN)), params, fit.agg(F.count(F.lit(1)).alias("n_fit"))


def ladder_code_length(spark, sf_dir):
    """Code length of the held-out runs by rung and history, the terms apart, for both treatments of abstention."""
    out = None
    for mode in MODES:
        one = l.code_length(*_scored(spark, sf_dir, mode), FPS).withColumn("abstain", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    nats = [F.round(c, 4).alias(c) for c in ("data_nats", "codebook_nats", "total_nats", "t_seconds", "nats_per_second", "data_nats_per_second", "nats_per_run")]
    return out.select("abstain", "rung", "k", "n_runs", "n_params", "n_fit", *nats)


def ladder_per_animal(spark, sf_dir):
    """Nats per second of each held-out animal, the codebook shared out by time."""
    out = l.per_animal(*_scored(spark, sf_dir, "conditioned"), FPS)
    return out.select("rung", "k", "animal", F.round("t_seconds", 4).alias("t_seconds"), F.round("nats_per_second", 4).alias("nats_per_second"))


_B = len(EDGES) - 1
_BIN = "(" + " + ".join(f"(greatest(duration - 1, 0) >= {e})::INT" for e in EDGES[1:-1]) + ")"
_GRID = "grid(bin, lo, hi) AS (VALUES " + ", ".join(f"({b}, {EDGES[b]}::BIGINT, {EDGES[b + 1]}::BIGINT)" for b in range(_B)) + ")"
_W = "(PARTITION BY abstain, recording ORDER BY run_id)"
_PAST = lambda i: f"coalesce(lag(code || ':' || b, {i}) OVER {_W}, '-')"
_SQL = f"""WITH {RUNS_SQL}, nx AS (SELECT *, lead(code) OVER (PARTITION BY recording ORDER BY run_id) AS nxt FROM runs),
p AS (SELECT 'conditioned' AS abstain, 4 AS a, recording, animal, split, run_id, code, duration, nullif(nxt, -1) AS next_state FROM nx WHERE code <> -1
  UNION ALL SELECT 'symbol', 5, recording, animal, split, run_id, CASE WHEN code = -1 THEN 4 ELSE code END, duration, CASE WHEN nxt = -1 THEN 4 ELSE nxt END FROM nx),
q AS (SELECT *, next_state IS NULL AS censored, greatest(duration - 1, 0) AS last, {_BIN} AS b FROM p),
f AS (SELECT * FROM q WHERE split = 'fit'), r AS (SELECT * FROM q WHERE split = 'report'), {_GRID},
tot AS (SELECT abstain, count(*) AS n_fit, count(*) FILTER (NOT censored) AS done, max(duration) AS longest FROM f GROUP BY 1),
pmf AS (SELECT t.abstain, g.bin, ln(CASE WHEN bin = {_B - 1} THEN greatest(longest - lo, 1) ELSE hi - lo END) - ln(coalesce(n, 0) + 1.0) + ln(n_fit + {_B}.0) AS dn
  FROM tot t CROSS JOIN grid g LEFT JOIN (SELECT abstain, b, count(*) AS n FROM f GROUP BY ALL) c ON c.abstain = t.abstain AND c.b = g.bin),
tc AS (SELECT abstain, code, next_state, count(*) AS n FROM f WHERE NOT censored GROUP BY ALL),
low AS (SELECT r.*, dn + CASE WHEN censored THEN 0 ELSE ln(done + a) - ln(coalesce(m, 0) + 1.0) END AS rung0, dn + CASE WHEN censored THEN 0 ELSE ln(coalesce(w, 0) + a - 1.0) - ln(coalesce(n, 0) + 1.0) END AS rung1
  FROM r JOIN tot USING (abstain) JOIN pmf ON pmf.abstain = r.abstain AND pmf.bin = r.b
  LEFT JOIN (SELECT abstain, next_state, sum(n) AS m FROM tc GROUP BY ALL) USING (abstain, next_state)
  LEFT JOIN (SELECT abstain, code, sum(n) AS w FROM tc GROUP BY ALL) USING (abstain, code) LEFT JOIN tc USING (abstain, code, next_state)),
keyed AS (SELECT *, code::VARCHAR AS c0, code || '|' || {_PAST(1)} AS c1, code || '|' || {_PAST(1)} || '|' || {_PAST(2)} AS c2 FROM q),
ctx AS (SELECT *, CASE k WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS context FROM keyed, (VALUES (0), (1), (2)) ks(k)),
over AS (SELECT abstain, a, split, recording, run_id, k, context, next_state, bin, least(last, hi) - lo AS stays, NOT censored AND last < hi AS leaves FROM ctx JOIN grid ON lo <= last),
cell AS (SELECT abstain, k, context, bin, sum(stays) + count(*) FILTER (leaves) AS at_risk, count(*) FILTER (leaves) AS gone FROM over WHERE split = 'fit' GROUP BY ALL HAVING sum(stays) + count(*) FILTER (leaves) > 0),
cause AS (SELECT abstain, k, context, bin, next_state, count(*) AS n FROM over WHERE split = 'fit' AND leaves GROUP BY ALL),
high AS (SELECT o.abstain, o.recording, o.run_id, o.k, sum(stays * (ln(coalesce(at_risk, 0) + a) - ln(coalesce(at_risk - gone, 0) + 1.0)) + CASE WHEN leaves THEN ln(coalesce(at_risk, 0) + a) - ln(coalesce(n, 0) + 1.0) ELSE 0 END) AS nats
  FROM over o LEFT JOIN cell USING (abstain, k, context, bin) LEFT JOIN cause USING (abstain, k, context, bin, next_state) WHERE split = 'report' GROUP BY ALL),
s AS (SELECT abstain, recording, run_id, 0 AS rung, 0 AS k, rung0 AS nats FROM low UNION ALL SELECT abstain, recording, run_id, 1, 0, rung1 FROM low UNION ALL SELECT abstain, recording, run_id, 2, k, nats FROM high),
par AS (SELECT abstain, 0 AS rung, 0 AS k, any_value(a) - 1 + {_B - 1} AS n_params FROM q GROUP BY 1 UNION ALL SELECT abstain, 1, 0, any_value(a) * (any_value(a) - 2) + {_B - 1} FROM q GROUP BY 1
  UNION ALL SELECT abstain, 2, k, count(*) * (SELECT any_value(a) - 1 FROM q WHERE q.abstain = cell.abstain) FROM cell GROUP BY abstain, k),
j AS (SELECT s.*, animal, duration, n_params, n_fit, n_params * 0.5 * ln(greatest(n_fit, 2)) AS book FROM s JOIN r USING (abstain, recording, run_id) JOIN par USING (abstain, rung, k) JOIN tot USING (abstain)),
"""
ORACLE = {
    "ladder_code_length": _SQL
    + f"""t AS (SELECT abstain, rung, k, count(*) AS n_runs, any_value(n_params)::BIGINT AS n_params, any_value(n_fit) AS n_fit, sum(nats) AS data_nats, any_value(book) AS codebook_nats, sum(duration) / {FPS}::DOUBLE AS t_seconds FROM j GROUP BY ALL)
SELECT abstain, rung, k, n_runs, n_params, n_fit, round(data_nats, 4) AS data_nats, round(codebook_nats, 4) AS codebook_nats, round(data_nats + codebook_nats, 4) AS total_nats, round(t_seconds, 4) AS t_seconds,
round((data_nats + codebook_nats) / t_seconds, 4) AS nats_per_second, round(data_nats / t_seconds, 4) AS data_nats_per_second, round(data_nats / n_runs, 4) AS nats_per_run FROM t""",
    "ladder_per_animal": _SQL
    + f"""t AS (SELECT rung, k, animal, sum(nats) AS nats, sum(duration) / {FPS}::DOUBLE AS t_seconds, any_value(book) AS book FROM j WHERE abstain = 'conditioned' GROUP BY ALL)
SELECT rung, k, animal, round(t_seconds, 4) AS t_seconds, round(nats / t_seconds + book / sum(t_seconds) OVER (PARTITION BY rung, k), 4) AS nats_per_second FROM t""",
}
QUERIES = {f.__name__: f for f in (ladder_code_length, ladder_per_animal)}
