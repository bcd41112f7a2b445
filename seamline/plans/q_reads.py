"""Further verdicts on one-row aggregates, and checks that distributions are distributions.

Each read names its numbers (a query and its SQL), the unit count, and rules tried in order; thresholds stand in ``RULES``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seamline.functions import verdict as v
from seamline.operators import resample as rs
from seamline.plans import q_eventhistory as qe
from seamline.plans import q_geometry as qgeo
from seamline.plans import q_groupstats as qg
from seamline.plans import q_homogeneity as qh
from seamline.plans import q_intervals as qi
from seamline.plans import q_more as qm
from seamline.plans import q_profiles as qp
from seamline.plans import q_segments as qs
from seamline.plans import q_stages as qst
from seamline.plans import q_tables as qt
from seamline.sources import adapters as a

R = lambda c, n=6: F.round(c, n)
#: Tolerances over which the violation rate is drawn as a curve; the verdict stands on the middle one.
CURVE = (0.05, 0.1, 0.2, 0.4, 0.8)

# Thresholds of the verdicts.
RULES = {
    "shuffled_ceiling": [("ceiling > observed", "PASS", "shuffling breaks what the measure sees"), ("ceiling <= observed", "FAIL", "shuffled poses violate no more than real ones")],
    "violation_curve": [("base < 0.02", "PASS", "few violations at the middle tolerance"), ("base < 0.15", "GRID_LIMITED", "some violations at the middle tolerance"), ("base >= 0.15", "FAIL", "violations are common")],
    "layer_concentration": [("inside > 0 and outside = 0", "PASS", "only flagged frames move"), ("inside >= 2 * outside", "PASS", "flagged frames move twice as far"), ("inside < 2 * outside", "FAIL", "flagged frames move about as far as others")],
    "recovery": [("raw_damage <> 0", "FAIL", "the baseline itself does damage"), ("left_error < raw_error and damage < 1", "PASS", "error falls and little is made elsewhere"), ("left_error < raw_error", "GRID_LIMITED", "error falls, at a price elsewhere"), ("left_error >= raw_error", "FAIL", "error stays")],
    "bakeoff": [("better > 0 and worse = 0", "PASS", "one arm dominates"), ("better > 0", "INCONCLUSIVE", "each arm wins an axis"), ("better = 0", "FAIL", "the incumbent is not beaten")],
    "assignment": [("own >= 0.999", "PASS", "assignments agree"), ("own < 0.999", "FAIL", "assignments differ")],
    "frailty": [("ratio < 0.5", "FAIL", "most of the fall goes within groups"), ("ratio >= 0.5", "PASS", "the fall holds within groups")],
    "homogeneity": [("lo > 0", "FAIL", "runs of a symbol have unlike futures"), ("hi < 0", "INCONCLUSIVE", "an excess under zero is no sign of coherence"), ("lo <= 0", "PASS", "the interval holds zero: runs of a symbol share a future")],
    "held_out_bones": [("least_before <= 0", "INCONCLUSIVE", "no violations to judge by"), ("least_fall > 0", "PASS", "violations fall on bones the correction never saw, both ways"), ("least_fall <= 0", "FAIL", "the correction satisfies the bones it was given and no others")],
    "chance_ceiling": [("lo > chance", "PASS", "raters agree more than scattered marks"), ("lo <= chance", "FAIL", "raters agree about as scattered marks do")],
    "isolation": [("share >= 0.2", "PASS", "a fifth of the planted runs is found as a segment"), ("share < 0.2", "FAIL", "too few planted runs are found as segments")],
    "truncation": [("kept >= 0.75 and kept <= 1.25", "PASS", "the mass over the cliff is kept"), ("kept < 0.75", "FAIL", "the filter takes mass over the cliff"), ("kept > 1.25", "FAIL", "the filter makes mass over the cliff")],
    "monotone": [("rising = 0 or falling = 0", "PASS", "the rate falls, or rises, all along"), ("rising > 0", "FAIL", "the rate turns")],
    "falsifier": [("lo > 0", "PASS", "the corpus exceeds its control"), ("hi < 0", "FAIL", "the control exceeds the corpus"), ("lo <= 0", "FAIL", "the interval spans zero")],
    "mark_rate": [("rate >= 0", "NOT_A_RESULT", "a rate of marks describes and judges nothing")],
    "breaks": [("boundaries = 0", "GRID_LIMITED", "no boundary at this threshold"), ("boundaries > 0", "NOT_A_RESULT", "boundaries have no truth to be judged by")],
    "context": [("lo > 0 or hi < 0", "PASS", "the interval excludes zero"), ("lo <= 0", "FAIL", "the interval spans zero")],
    "anchor": [("abs(pct - 0.5) <= 0.02", "PASS", "a random draw sits in the middle"), ("abs(pct - 0.5) > 0.02", "FAIL", "a random draw is off the middle")],
    "recurrence": [("lo > 0", "PASS", "recurrence exceeds its null"), ("lo <= 0", "FAIL", "recurrence does not exceed its null")],
    "gate": [("hi < 0", "FAIL", "the gate is under the floor"), ("lo > 0", "PASS", "the gate is over the floor"), ("lo <= 0", "PASS", "weakly: the interval spans the floor")],
    "power": [("mde <= 0.1", "PASS", "a plausible effect can be seen"), ("mde > 0.1", "NOT_A_RESULT", "only an implausible effect could be seen")],
    "accuracy": [("lo > 1.0 / 3", "PASS", "better than chance among three"), ("lo <= 1.0 / 3", "FAIL", "not better than chance among three")],
    "wide_participation": [("share >= 0.5", "PASS", "a component that half of all animals take part in"), ("share < 0.5", "FAIL", "components are local")],
    "unassigned": [("share > 0.9", "NOT_A_RESULT", "nearly nothing is assigned"), ("share <= 0.9", "PASS", "enough is assigned")],
    "chaining": [("over * 2 > n", "FAIL", "most components are chains"), ("over * 2 <= n", "PASS", "most components are compact")],
    "dwell": [("passed = 2", "PASS", "both required verdicts pass"), ("found < 2", "NOT_A_RESULT", "a required verdict is missing"), ("passed < 2", "FAIL", "a required verdict does not pass")],
    "speed_ratio": [("lo > 1", "PASS", "faster inside"), ("hi < 1", "PASS", "slower inside"), ("lo <= 1", "FAIL", "the interval spans one")],
}
v.RULES |= {k: r for k, r in RULES.items() if k not in v.RULES}


def violation_curve(spark, sf_dir):
    """Rate of over-long bones by tolerance, and whether it falls all along."""
    lengths = qgeo.lengths(spark, sf_dir)
    ref = lengths.groupBy("recording", "bone").agg(F.percentile("d", 0.9).alias("l_hat"))
    eps = F.explode(F.array(*[F.lit(e) for e in CURVE])).alias("eps")
    hit = F.coalesce(F.col("d") / F.col("l_hat") > 1 + F.col("eps"), F.lit(False))
    return lengths.join(ref, ["recording", "bone"]).select("*", eps).groupBy("eps").agg(F.count(F.lit(1)).alias("n"), R(F.avg(hit.cast("int"))).alias("rate"))


_CURVE = f"""WITH {qgeo._LEN}, ref AS (SELECT recording, bone, quantile_cont(d, 0.9) AS l_hat FROM len GROUP BY ALL), e AS (SELECT unnest([{", ".join(map(str, CURVE))}])::DOUBLE AS eps)
SELECT eps, count(*) AS n, round(avg(coalesce(d / l_hat > 1 + eps, false)::INT), 6) AS rate FROM len JOIN ref USING (recording, bone), e GROUP BY eps"""


def _interval(rows, value, group="animal"):
    return rs.cluster_interval(rows.select(group, F.col(value).alias("value"), F.lit(1.0).alias("w")), group, "value", "w", n_boot=qg.N_BOOT)


def _per_animal(df, value):
    return df.groupBy("animal").agg(R(F.avg(value)).alias(value))


def _mark_rate(spark, sf_dir):
    m = a.marks(spark, sf_dir)
    return m.agg((F.count(F.lit(1)) / (F.max("frame") - F.min("frame") + 1)).alias("rate"), F.count(F.lit(1)).alias("n"))


def _arms(spark, sf_dir):
    w = qm.injection_repair(spark, sf_dir)
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    return w.agg(of("raw", "left_error").alias("raw_error"), of("raw", "damage").alias("raw_damage"), of("median", "left_error").alias("left_error"), of("median", "damage").alias("damage"),
                 of("gate", "left_error").alias("gate_error"), of("gate", "damage").alias("gate_damage"), F.max("injected").alias("n"))


_ARMS = f"""SELECT max(left_error) FILTER (arm = 'raw') AS raw_error, max(damage) FILTER (arm = 'raw') AS raw_damage, max(left_error) FILTER (arm = 'median') AS left_error, max(damage) FILTER (arm = 'median') AS damage,
max(left_error) FILTER (arm = 'gate') AS gate_error, max(damage) FILTER (arm = 'gate') AS gate_damage, max(injected) AS n FROM ({qm.ORACLE["injection_repair"]})"""


def _bakeoff(spark, sf_dir):
    w = _arms(spark, sf_dir)
    axis = lambda op: sum(op(F.col(f"gate_{c}"), F.col(o)).cast("int") for c, o in (("error", "left_error"), ("damage", "damage")))
    return w.select(axis(lambda x, y: x < y).alias("better"), axis(lambda x, y: x > y).alias("worse"), "n")


def _dwell(spark, sf_dir):
    both = qm.verdict_run_lengths(spark, sf_dir).unionByName(qm.verdict_envelope(spark, sf_dir))
    return both.agg(F.count(F.lit(1)).alias("found"), F.sum((F.col("verdict") == "PASS").cast("int")).alias("passed"), F.min("n_effective").alias("n"))


def _spread(spark, sf_dir):
    every = a.bank(spark, sf_dir).agg(F.count_distinct("animal").alias("all"))
    return qs.participation(spark, sf_dir).agg(F.max("animals").alias("most"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(every)).select((F.col("most") / F.col("all")).alias("share"), "n")


def _unassigned(spark, sf_dir):
    out = a.bank(spark, sf_dir).select("unit").join(qs.clump_components(spark, sf_dir), "unit", "left")
    return out.agg(F.avg(F.col("component").isNull().cast("int")).alias("share"), F.count(F.lit(1)).alias("n"))


def _inside(spark, sf_dir):
    g = a.groups(spark, sf_dir).groupBy("animal").agg(F.avg(F.when(F.col("mask"), F.col("value"))).alias("i"), F.avg(F.when(~F.col("mask"), F.col("value"))).alias("o"))
    return g.select("animal", R(F.col("i") / F.col("o")).alias("ratio")).where("ratio is not null")


def _chance(spark, sf_dir):
    out = qi.chance_agreement(spark, sf_dir)
    ci = _interval(_per_animal(out.withColumn("animal", F.col("clip") % 10), "f1"), "f1")
    return ci.select("lo", "n_clusters").crossJoin(F.broadcast(out.agg(F.avg("chance_f1").alias("chance"))))  # one row


def _wins(spark, sf_dir):
    """How much more often than ``FLOOR`` a segment's fit beats drawn intervals of its length, by animal."""
    w = qi.length_matched_fits(spark, sf_dir).withColumn("animal", F.col("recording") % 10)
    return w.groupBy("animal").agg(R(F.avg("win_rate") - FLOOR).alias("margin"))


#: Fixed value: the win rate that this control is held against.
FLOOR = 0.659
_WINS = f"SELECT recording % 10 AS animal, round(avg(win_rate) - {FLOOR}, 6) AS margin FROM ({qi.ORACLE['length_matched_fits']}) GROUP BY 1"
_BY_CLIP = f"SELECT clip % 10 AS animal, round(avg(f1), 6) AS f1 FROM ({qi.ORACLE['chance_agreement']}) GROUP BY 1"
_INSIDE = f"WITH {a.GROUPS_SQL} SELECT animal, round(avg(value) FILTER (mask) / avg(value) FILTER (NOT mask), 6) AS ratio FROM groups GROUP BY animal HAVING ratio IS NOT NULL"
_BY_ANIMAL = "SELECT animal, round(avg({c}), 6) AS {c} FROM ({q}) GROUP BY animal"

#: name: (numbers, their SQL, unit count, least units)
READS = {
    "shuffled_ceiling": (
        lambda s, d: qgeo._viol(s, d).agg(F.avg(F.col("viol").cast("int")).alias("observed"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(qp.shuffled_ceiling(s, d).agg(F.avg("rate").alias("ceiling")))),
        f"WITH {qgeo._VIOL} SELECT avg(viol::INT) AS observed, count(*) AS n, (SELECT avg(rate) FROM ({qp.ORACLE['shuffled_ceiling']})) AS ceiling FROM viol", "n", 1),
    "violation_curve": (
        lambda s, d: violation_curve(s, d).agg(F.max(F.when(F.col("eps") == CURVE[2], F.col("rate"))).alias("base"), F.max("n").alias("n")),
        f"SELECT max(rate) FILTER (eps = {CURVE[2]}) AS base, max(n) AS n FROM ({_CURVE})", "n", 1),
    "layer_concentration": (
        lambda s, d: qg.displacement_by_flag(s, d).agg(F.max(F.when(F.col("flagged"), F.col("mean"))).alias("inside"), F.max(F.when(~F.col("flagged"), F.col("mean"))).alias("outside"), F.sum("n").alias("n")),
        f"SELECT max(mean) FILTER (flagged) AS inside, max(mean) FILTER (NOT flagged) AS outside, sum(n) AS n FROM ({qg.ORACLE['displacement_by_flag']})", "n", 1),
    "recovery": (_arms, _ARMS, "n", 1),
    "bakeoff": (_bakeoff, f"SELECT (gate_error < left_error)::INT + (gate_damage < damage)::INT AS better, (gate_error > left_error)::INT + (gate_damage > damage)::INT AS worse, n FROM ({_ARMS})", "n", 1),
    "assignment": (
        lambda s, d: qm.distortion(s, d).agg((F.sum(F.col("own") * F.col("n")) / F.sum("n")).alias("own"), F.sum("n").alias("n")),
        f"SELECT sum(own * n) / sum(n) AS own, sum(n) AS n FROM ({qm.ORACLE['distortion']})", "n", 1),
    "frailty": (
        lambda s, d: qe.fall_ratio(s, d).agg(F.min("ratio").alias("ratio"), F.count(F.lit(1)).alias("n")),
        f"SELECT min(ratio) AS ratio, count(*) AS n FROM ({qe.ORACLE['fall_ratio']})", "n", 1),
    "homogeneity": (lambda s, d: qh.homogeneity_excess(s, d).select("lo", "hi", "n_groups"), f"SELECT lo, hi, n_groups FROM ({qh.ORACLE['homogeneity_excess']})", "n_groups", 3),
    "held_out_bones": (
        lambda s, d: qt.held_out_rate(s, d).agg(F.min("before").alias("least_before"), F.min("relative_fall").alias("least_fall"), F.sum("n").alias("n")),
        f"SELECT min(before) AS least_before, min(relative_fall) AS least_fall, sum(n) AS n FROM ({qt.ORACLE['held_out_rate']})", "n", 1),
    "chance_ceiling": (_chance, f"SELECT b.lo, c.chance, b.n_clusters FROM ({qm._boot(_BY_CLIP, 'f1')}) b, (SELECT avg(chance_f1) AS chance FROM ({qi.ORACLE['chance_agreement']})) c", "n_clusters", 2),
    "isolation": (
        lambda s, d: qi.planted_run_classes(s, d).agg((F.sum("isolated") / F.sum("n_instances")).alias("share"), F.sum("n_instances").alias("n")),
        f"SELECT sum(isolated) / sum(n_instances) AS share, sum(n_instances) AS n FROM ({qi.ORACLE['planted_run_classes']})", "n", 1),
    "truncation": (
        lambda s, d: qst.stage_run_lengths(s, d).where("arm = 'smoothed'").select("kept", "n"),
        f"SELECT kept, n FROM ({qst.ORACLE['stage_run_lengths']}) WHERE arm = 'smoothed'", "n", 1),
    "monotone": (
        lambda s, d: violation_curve(s, d).withColumn("step", F.col("rate") - F.lag("rate").over(Window.orderBy("eps"))).agg(F.sum((F.col("step") > 0).cast("int")).alias("rising"), F.sum((F.col("step") < 0).cast("int")).alias("falling"), F.count("rate").alias("n")),  # five rows
        f"SELECT count(*) FILTER (step > 0) AS rising, count(*) FILTER (step < 0) AS falling, count(rate) AS n FROM (SELECT rate, rate - lag(rate) OVER (ORDER BY eps) AS step FROM ({_CURVE}))", "n", 3),
    "falsifier": (lambda s, d: _interval(qm.paired_excess(s, d), "excess"), qm._boot(qm.ORACLE["paired_excess"], "excess"), "n_clusters", 2),
    "mark_rate": (_mark_rate, f"WITH {a.MARKS_SQL} SELECT count(*) / (max(frame) - min(frame) + 1) AS rate, count(*) AS n FROM marks", "n", 1),
    "breaks": (
        lambda s, d: qs.nms_boundaries(s, d).agg(F.count(F.lit(1)).alias("boundaries"), F.count_distinct("recording").alias("n")),
        f"SELECT count(*) AS boundaries, count(DISTINCT recording) AS n FROM ({qs.ORACLE['nms_boundaries']})", "n", 0),
    "context": (lambda s, d: _interval(_per_animal(qg.paired_deltas(s, d), "delta"), "delta"), qm._boot(_BY_ANIMAL.format(c="delta", q=qg.ORACLE["paired_deltas"]), "delta"), "n_clusters", 2),
    "anchor": (
        lambda s, d: qg.percentile_of(s, d).agg((F.sum(F.col("mean_pct") * F.col("n")) / F.sum("n")).alias("pct"), F.sum("n").alias("n")),
        f"SELECT sum(mean_pct * n) / sum(n) AS pct, sum(n) AS n FROM ({qg.ORACLE['percentile_of']})", "n", 1),
    "recurrence": (lambda s, d: _interval(qst.stage_recurrence(s, d), "excess"), qm._boot(qst.ORACLE["stage_recurrence"], "excess"), "n_clusters", 2),
    "gate": (lambda s, d: _interval(_wins(s, d), "margin"), qm._boot(_WINS, "margin"), "n_clusters", 2),
    "power": (
        lambda s, d: qp.detectable_effect(s, d).agg(F.max("mde").alias("mde"), F.count(F.lit(1)).alias("n")),
        f"SELECT max(mde) AS mde, count(*) AS n FROM ({qp.ORACLE['detectable_effect']})", "n", 1),
    "accuracy": (lambda s, d: _interval(qg.grouped_rates(s, d), "rate"), qm._boot(qg.ORACLE["grouped_rates"], "rate"), "n_clusters", 2),
    "wide_participation": (_spread, f"SELECT max(animals) / (SELECT count(DISTINCT label) FROM embeddings) AS share, count(*) AS n FROM ({qs.ORACLE['participation']})", "n", 1),
    "unassigned": (_unassigned, f"SELECT avg((component IS NULL)::INT) AS share, count(*) AS n FROM (SELECT vec_id AS unit FROM embeddings) LEFT JOIN ({qs.ORACLE['clump_components']}) USING (unit)", "n", 1),
    "chaining": (
        lambda s, d: qp.clump_diameter(s, d).agg(F.sum((F.col("widest") > 3 * F.col("median")).cast("int")).alias("over"), F.count(F.lit(1)).alias("n")),
        f"SELECT count(*) FILTER (widest > 3 * median) AS over, count(*) AS n FROM ({qp.ORACLE['clump_diameter']})", "n", 1),
    "dwell": (_dwell, f"SELECT count(*) AS found, count(*) FILTER (verdict = 'PASS') AS passed, min(n_effective) AS n FROM (({qm.ORACLE['verdict_run_lengths']}) UNION ALL ({qm.ORACLE['verdict_envelope']}))", "n", 1),
    "speed_ratio": (lambda s, d: _interval(_inside(s, d), "ratio"), qm._boot(_INSIDE, "ratio"), "n_clusters", 2),
}


def _query(name):
    numbers, _, n, least = READS[name]

    def query(spark, sf_dir):
        return v.read(name, numbers(spark, sf_dir), RULES[name], n, least)

    query.__name__ = f"verdict_{name}"
    return query


def distribution_checks(spark, sf_dir):
    """Shares that have to be non-negative, finite and sum to one, or lie between zero and one: worst deviation and whether it holds."""
    f = a.frames(spark, sf_dir)
    occ = f.groupBy("code").agg(F.count(F.lit(1)).alias("k"))
    total = occ.agg(F.sum("k").alias("t"))
    share = occ.crossJoin(F.broadcast(total)).select(F.lit("occupancy_pmf").alias("name"), F.lit("all").alias("part"), (F.col("k") / F.col("t")).alias("p"))
    moves = qe.transition_counts(spark, sf_dir).groupBy("split", "code", "next_state").agg(F.sum("n").alias("n"))
    rows = moves.groupBy("split", "code").agg(F.sum("n").alias("t"))
    step = moves.join(rows, ["split", "code"]).select(F.lit("transition_log_pmf"), F.concat_ws("/", "split", "code"), F.exp(F.log(F.col("n") / F.col("t"))))
    sums = share.unionByName(step.toDF("name", "part", "p")).groupBy("name", "part").agg(F.sum("p").alias("s"), F.min("p").alias("least"))
    unit = sums.groupBy("name").agg(F.count(F.lit(1)).alias("n"), R(F.max(F.abs(F.col("s") - 1))).alias("worst"), ((F.max(F.abs(F.col("s") - 1)) <= 1e-9) & (F.min("least") >= 0)).alias("holds"))
    rate = qg.grouped_rates(spark, sf_dir).agg(F.lit("rate_share").alias("name"), F.count(F.lit(1)).alias("n"), R(F.max(F.greatest(F.col("rate") - 1, -F.col("rate"), F.lit(0.0)))).alias("worst"), F.bool_and((F.col("rate") >= 0) & (F.col("rate") <= 1)).alias("holds"))
    return unit.unionByName(rate)


QUERIES = {f"verdict_{k}": _query(k) for k in READS} | {"violation_curve": violation_curve, "distribution_checks": distribution_checks}
ORACLE = {f"verdict_{k}": qm._read(k, sql, n, least) for k, (_, sql, n, least) in READS.items()} | {
    "violation_curve": _CURVE,
    "distribution_checks": f"""WITH {a.FRAMES_SQL}, occ AS (SELECT code, count(*) AS k FROM frames GROUP BY 1), tr AS ({qe.ORACLE['transition_counts']}),
p AS (SELECT 'occupancy_pmf' AS name, 'all' AS part, k / sum(k) OVER () AS p FROM occ UNION ALL SELECT 'transition_log_pmf', split || '/' || code, exp(ln(n / sum(n) OVER (PARTITION BY split, code))) FROM tr),
s AS (SELECT name, part, sum(p) AS s, min(p) AS least FROM p GROUP BY ALL)
SELECT name, count(*) AS n, round(max(abs(s - 1)), 6) AS worst, max(abs(s - 1)) <= 1e-9 AND min(least) >= 0 AS holds FROM s GROUP BY name
UNION ALL SELECT 'rate_share', count(*), round(max(greatest(rate - 1, -rate, 0)), 6), bool_and(rate BETWEEN 0 AND 1) FROM ({qg.ORACLE['grouped_rates']})""",
}
