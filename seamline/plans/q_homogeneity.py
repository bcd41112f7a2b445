"""Queries on whether runs of one symbol share a future."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seamline.operators import eventhistory as h
from seamline.operators import permutation as pm
from seamline.operators import ranking as rk
from seamline.operators.ordered import prepare
from seamline.operators.segments import durable
from seamline.plans.q_eventhistory import EDGES
from seamline.sources import adapters as a

SEED = 7
R = lambda c, n=6: F.round(c, n)


def labelled_runs(spark, sf_dir):
    """Runs with their mean signal, its quartile within the symbol, next state and duration bin."""
    w = Window.partitionBy("recording").orderBy("t")
    new = F.when(F.lag("code").over(w).eqNullSafe(F.col("code")), 0).otherwise(1)
    f = a.frames(spark, sf_dir).withColumn("new", new).withColumn("run_id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = f.groupBy("recording", "animal", "run_id").agg(F.first("code").alias("code"), F.count(F.lit(1)).alias("duration"), R(F.avg("x"), 9).alias("mean"))
    runs = prepare(runs, "conditioned").withColumn("duration_bin", h.bin_of(F.col("duration") - 1, EDGES))
    return rk.quartiles_within(runs, "mean", ["code"], ["recording", "run_id"])


def symbol_permutation_table(spark, sf_dir):
    """Near and far runs of each symbol: distance, null, excess and p over 2,000 replicates."""
    out = pm.symbol_table(labelled_runs(spark, sf_dir), SEED)
    return out.select("symbol", "what", "n_runs", "frames", "n_near", "n_far", *[R(c).alias(c) for c in ("tv", "null", "excess", "p")])


def homogeneity_excess(spark, sf_dir):
    """The excess over all symbols, its interval by leaving out one animal at a time, and the descriptive failing share."""
    runs = durable(labelled_runs(spark, sf_dir))
    table = durable(pm.symbol_table(runs, SEED))
    point = durable(pm.aggregate(table))
    ci = pm.interval(pm.leave_one_out(runs, table, "animal", SEED), point)
    out = point.crossJoin(F.broadcast(ci))  # one row each
    names = ("excess", "excess_unweighted", "tv", "null", "failing_share", "failing_frames", "se", "lo", "hi")
    return out.select("n_symbols", "n_groups", *[R(c).alias(c) for c in names])


QUERIES = {f.__name__: f for f in (symbol_permutation_table, homogeneity_excess)}

_BIN = " + ".join(f"(duration - 1 >= {e})::INT" for e in EDGES[1:-1])
_RUNS = f"""{a.FRAMES_SQL}, mk AS (SELECT *, CASE WHEN lag(code) OVER (PARTITION BY recording ORDER BY t) = code THEN 0 ELSE 1 END AS new FROM frames),
nm AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY t ROWS UNBOUNDED PRECEDING) AS run_id FROM mk),
rn AS (SELECT recording, animal, run_id, min(code) AS code, count(*) AS duration, round(avg(x), 9) AS mean FROM nm GROUP BY ALL),
nx AS (SELECT *, lead(code) OVER (PARTITION BY recording ORDER BY run_id) AS nxt FROM rn),
kept AS (SELECT *, nullif(nxt, -1)::BIGINT AS next_state, ({_BIN})::BIGINT AS bin, (4 * row_number() OVER (PARTITION BY code ORDER BY mean, recording, run_id) - 1) // count(*) OVER (PARTITION BY code) AS quartile FROM nx WHERE code <> -1),
ends AS (SELECT *, quartile = 0 AS side FROM kept WHERE quartile IN (0, 3)),
long AS (SELECT animal, code AS symbol, side, 'next' AS what, next_state AS v, duration FROM ends WHERE next_state IS NOT NULL UNION ALL SELECT animal, code, side, 'duration', bin, duration FROM ends)"""


def _floyd(total, key):
    n = pm.N_FIX
    u = f"(('0x' || substr(md5({key} || '|' || (i // 4)), 8 * (i % 4) + 1, 8))::BIGINT / 4294967296.0)"
    tried = f"list_transform(range(0, {n}), lambda i: [({total}) - {n} + i, floor({u} * (({total}) - {n} + i + 1))::BIGINT])"
    return f"list_reduce(list_prepend([]::BIGINT[], {tried}), lambda s, e: list_append(s, CASE WHEN list_contains(s, e[2]) THEN e[1] ELSE e[2] END))"


def _falling(places, counts):
    upto = f"list_transform(range(1, len({counts}) + 1), lambda k: len(list_filter({places}, lambda p: p < list_sum({counts}[1:k]))))"
    return f"(SELECT list_transform(range(1, len(g) + 1), lambda k: g[k] - CASE WHEN k = 1 THEN 0 ELSE g[k - 1] END) FROM (SELECT {upto} AS g))"


def _draws(rows, key, keep, name):
    """CTEs from rows (near, far, tn, tf, and what ``keep`` names) to (keep, observed, null)."""
    n = pm.N_FIX
    tv = lambda x, y: f"list_sum(list_transform(range(1, len({x}) + 1), lambda k: abs({x}[k] - {y}[k]))) / {2.0 * n}"
    return f"""{name}1 AS (SELECT *, {_floyd("tn", key + " || '|near'")} AS pn, {_floyd("tf", key + " || '|far'")} AS pf, {_floyd(str(2 * n), key + " || '|null'")} AS p0 FROM {rows}),
{name}2 AS (SELECT *, {_falling("pn", "near")} AS dn, {_falling("pf", "far")} AS df FROM {name}1),
{name}3 AS (SELECT *, list_transform(range(1, len(dn) + 1), lambda k: dn[k] + df[k]) AS pool FROM {name}2),
{name}4 AS (SELECT *, {_falling("p0", "pool")} AS again FROM {name}3),
{name}5 AS (SELECT *, list_transform(range(1, len(pool) + 1), lambda k: pool[k] - again[k]) AS other FROM {name}4),
{name} AS (SELECT {keep}, {tv("dn", "df")} AS observed, {tv("again", "other")} AS "null" FROM {name}5)"""


_STACK = "list({0} ORDER BY v)::BIGINT[] AS {0}"
_TABLE = f"""{_RUNS}, mass AS (SELECT code AS symbol, count(*) AS n_runs, sum(duration)::BIGINT AS frames FROM ends GROUP BY 1 HAVING count(*) >= {pm.MIN_RUNS}),
cnt AS (SELECT symbol, what, v, count(*) FILTER (side) AS near, count(*) FILTER (NOT side) AS far FROM long GROUP BY ALL),
st AS (SELECT symbol, what, {_STACK.format("near")}, {_STACK.format("far")}, sum(near)::BIGINT AS tn, sum(far)::BIGINT AS tf FROM cnt GROUP BY ALL),
rows AS (SELECT m.*, w.what, near, far, tn, tf FROM mass m CROSS JOIN (VALUES ('next'), ('duration')) w(what) LEFT JOIN st ON st.symbol = m.symbol AND st.what = w.what),
reps AS (SELECT symbol, what, near, far, tn, tf, rep FROM rows, range({pm.N_PERM}) r(rep) WHERE least(tn, tf) >= {pm.N_FIX} AND tn + tf >= {pm.MIN_RUNS // 2}),
{_draws("reps", f"'{SEED}|' || symbol || '|' || what || '|' || rep", "symbol, what", "dr")},
mn AS (SELECT symbol, what, avg(observed) AS tv, avg("null") AS nul FROM dr GROUP BY ALL),
tab AS (SELECT r.symbol, r.what, n_runs, frames, tn AS n_near, tf AS n_far, tv, nul, tv - nul AS excess, (1 + (SELECT count(*) FROM dr WHERE dr.symbol = r.symbol AND dr.what = r.what AND "null" >= tv - 1e-12)) / {pm.N_PERM + 1} AS p FROM rows r LEFT JOIN mn USING (symbol, what))"""
ORACLE = {
    "symbol_permutation_table": f"""WITH {_TABLE} SELECT symbol, what, n_runs, frames, n_near, n_far, round(tv, 6) AS tv, round(nul, 6) AS "null", round(excess, 6) AS excess, CASE WHEN tv IS NOT NULL THEN round(p, 6) END AS p FROM tab""",
    "homogeneity_excess": f"""WITH {_TABLE}, live AS (SELECT *, row_number() OVER (ORDER BY p, symbol) AS r, count(*) OVER () AS m FROM tab WHERE what = 'next' AND excess IS NOT NULL),
cutp AS (SELECT max(p) AS cut FROM live WHERE p <= 0.05 * r / m),
ag AS (SELECT count(*) AS n_symbols, sum(excess * frames) / sum(frames) AS excess, avg(excess) AS excess_unweighted, sum(tv * frames) / sum(frames) AS tv, sum(nul * frames) / sum(frames) AS nul,
  avg(coalesce(p <= cut, false)::INT) AS failing_share, coalesce(sum(frames) FILTER (p <= cut), 0) / sum(frames) AS failing_frames FROM live, cutp),
own AS (SELECT animal, symbol, v, count(*) FILTER (side) AS near, count(*) FILTER (NOT side) AS far FROM long WHERE what = 'next' GROUP BY ALL),
al AS (SELECT symbol, v, sum(near)::BIGINT AS an, sum(far)::BIGINT AS af FROM own GROUP BY ALL), an AS (SELECT DISTINCT animal FROM own),
lf AS (SELECT an.animal, al.symbol, al.v, al.an - coalesce(near, 0) AS near, al.af - coalesce(far, 0) AS far FROM an CROSS JOIN al LEFT JOIN own ON own.animal = an.animal AND own.symbol = al.symbol AND own.v = al.v),
ls AS (SELECT animal, symbol, {_STACK.format("near")}, {_STACK.format("far")}, sum(near)::BIGINT AS tn, sum(far)::BIGINT AS tf FROM lf GROUP BY ALL HAVING least(sum(near), sum(far)) >= {pm.N_FIX}),
{_draws("ls", f"'{SEED}|' || symbol || '|next|without|' || animal", "animal, symbol", "lo")},
ms AS (SELECT animal, symbol, sum(duration)::BIGINT AS w FROM long WHERE what = 'next' GROUP BY ALL), wh AS (SELECT symbol, sum(w) AS all_w FROM ms GROUP BY 1),
th AS (SELECT lo.animal, sum((all_w - coalesce(w, 0)) * (observed - nul)) / sum(all_w - coalesce(w, 0)) AS theta FROM lo JOIN live USING (symbol) JOIN wh USING (symbol) LEFT JOIN ms ON ms.animal = lo.animal AND ms.symbol = lo.symbol GROUP BY 1),
ci AS (SELECT count(theta) AS n_groups, CASE WHEN count(theta) >= 3 THEN sqrt((count(theta) - 1) * var_pop(theta)) END AS se FROM th)
SELECT n_symbols, n_groups, round(excess, 6) AS excess, round(excess_unweighted, 6) AS excess_unweighted, round(tv, 6) AS tv, round(nul, 6) AS "null", round(failing_share, 6) AS failing_share, round(failing_frames, 6) AS failing_frames,
round(se, 6) AS se, round(excess - 1.96 * se, 6) AS lo, round(excess + 1.96 * se, 6) AS hi FROM ag, ci""",
}
