"""Queries on twists and their controls, scale-free lengths, strata, code length with its charge, marks and descriptive tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seamline.operators import geometry as g
from seamline.operators import groupstats as gs
from seamline.operators import ranking as rk
from seamline.operators.segments import durable
from seamline.plans import q_eventhistory as qe
from seamline.plans import q_geometry as qgeo
from seamline.plans import q_groupstats as qg
from seamline.plans import q_more as qm
from seamline.plans import q_ordered as qo
from seamline.plans import q_segments as qs
from seamline.sources import adapters as a

R = lambda c, n=6: F.round(c, n)
FPS = 30.0
N_STRATA, N_STATES = 5, 64
#: Multiples of the spread at which boundaries are counted, and the guard of a mark's neighbourhood in frames.
LEVELS = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0)
#: Bones of the two halves of the body.
HALVES = {"front": (0, 1, 2), "back": (3, 4, 5)}
TOLERANCE = 2
SALT = "trials"


def window_frames(seconds: float, fps: float = FPS, odd: bool = True) -> int:
    """Frames of a window, at least one; odd windows have a middle frame."""
    n = max(1, round(seconds * fps))
    return n + 1 if odd and n % 2 == 0 else n


def guard_frames(fps: float = FPS, deriv_seconds: float = 0.2) -> int:
    """Frames to leave at either end of a segment: half the derivative's window, at least one."""
    return max(1, round(deriv_seconds / 2 * fps))


def least_frames(degree: int, times: int = 3) -> int:
    """Frames that a polynomial of a degree needs to be told from noise."""
    return times * (degree + 1)


def allocate(n_states: int, n_strata: int) -> list[int]:
    """States per stratum: as even as can be, the first strata get what is left over."""
    return [n_states // n_strata + (i < n_states % n_strata) for i in range(n_strata)]


def _w():
    return Window.partitionBy("recording").orderBy("t")


def exp_roundtrip(spark, sf_dir):
    """Largest error of body-frame displacements that the exponential of the twist gives back, per recording."""
    t = g.twist(a.pose(spark, sf_dir), F.lit(0.5))
    origin = F.get("pose", g.ORIGIN)
    theta = g.heading(F.get("pose", g.TAIL), F.get("pose", g.NOSE))
    p = a.pose(spark, sf_dir).select("recording", "t", theta.alias("th"), origin["x"].alias("ox"), origin["y"].alias("oy"))
    dx, dy = F.lead("ox").over(_w()) - F.col("ox"), F.lead("oy").over(_w()) - F.col("oy")
    p = p.select("recording", "t", (F.cos("th") * dx + F.sin("th") * dy).alias("ux"), (F.cos("th") * dy - F.sin("th") * dx).alias("uy"))
    w = F.col("omega") / FPS
    vx, vy = F.col("v_x") / FPS * 0.5, F.col("v_y") / FPS * 0.5
    s = F.when(F.abs(w) < 1e-4, 1 - w * w / 6).otherwise(F.sin(w) / w)
    c = F.when(F.abs(w) < 1e-4, w / 2).otherwise((1 - F.cos(w)) / w)
    both = t.select("recording", "t", "v_x", "v_y", "omega").join(p, ["recording", "t"]).where("ux is not null")
    err = F.greatest(F.abs(s * vx - c * vy - F.col("ux")), F.abs(c * vx + s * vy - F.col("uy")))
    return both.groupBy("recording").agg(F.count(F.lit(1)).alias("n"), R(F.max(err)).alias("worst"))


def naive_velocity(spark, sf_dir):
    """Control without the logarithm: steps of the origin as velocities, from the poses themselves, beside the twist's."""
    pose = a.pose(spark, sf_dir)
    o = pose.withColumn("o", F.get("pose", g.ORIGIN))
    to = F.lead("o").over(_w())
    step = F.sqrt((to["x"] - F.col("o.x")) ** 2 + (to["y"] - F.col("o.y")) ** 2) * FPS / 0.5
    t = qgeo.twist_se2(spark, sf_dir).join(o.select("recording", "t", step.alias("naive")), ["recording", "t"])
    out = t.where("v_x is not null").select("recording", F.sqrt(F.col("v_x") ** 2 + F.col("v_y") ** 2).alias("speed"), "naive")
    return out.groupBy("recording").agg(F.count(F.lit(1)).alias("n"), R(F.avg("speed"), 4).alias("speed"), R(F.avg("naive"), 4).alias("naive"), R(F.avg(F.abs(F.col("speed") - F.col("naive"))), 4).alias("gap"))


def naive_reverse_twist(spark, sf_dir):
    """Control: rows in reversed order without changed signs, within each recording."""
    t = qgeo.twist_se2(spark, sf_dir).where("v_x is not null")
    n = F.count(F.lit(1)).over(Window.partitionBy("recording"))
    at = F.row_number().over(_w()).cast("long")
    t = t.withColumns({"i": at, "j": n - at + 1})
    back = t.select("recording", F.col("j").alias("i"), F.col("v_x").alias("b"))
    return t.join(back, ["recording", "i"]).groupBy("recording").agg(F.count(F.lit(1)).alias("n"), R(F.avg(F.abs(F.col("v_x") - F.col("b"))), 4).alias("differs"))


_TW = f"tw AS ({qgeo.ORACLE['twist_se2']})"
_ROUND = f"""WITH {qgeo._BODY}, n AS (SELECT *, lead(theta) OVER w - theta AS d, lead(ox) OVER w - ox AS dx, lead(oy) OVER w - oy AS dy FROM th WINDOW w AS (PARTITION BY recording ORDER BY t)),
u AS (SELECT recording, t, (d + pi()) - floor((d + pi()) / (2 * pi())) * 2 * pi() - pi() AS w, cos(theta) * dx + sin(theta) * dy AS ux, cos(theta) * dy - sin(theta) * dx AS uy FROM n WHERE dx IS NOT NULL),
c AS (SELECT *, CASE WHEN abs(w) < 1e-4 THEN 1 - w * w / 12 ELSE (w / 2) / tan(w / 2) END AS cot FROM u), v AS (SELECT *, cot * ux + w / 2 * uy AS vx, cot * uy - w / 2 * ux AS vy FROM c),
b AS (SELECT *, CASE WHEN abs(w) < 1e-4 THEN 1 - w * w / 6 ELSE sin(w) / w END AS s, CASE WHEN abs(w) < 1e-4 THEN w / 2 ELSE (1 - cos(w)) / w END AS k FROM v)
SELECT recording, count(*) AS n, round(max(greatest(abs(s * vx - k * vy - ux), abs(k * vx + s * vy - uy))), 6) AS worst FROM b GROUP BY recording"""


def scalefree_lengths(spark, sf_dir):
    """Median log length of a frame's bones as its scale; lengths over it, by recording and bone."""
    d = qgeo.lengths(spark, sf_dir).where("d > 0")
    scale = F.percentile(F.log("d"), 0.5).over(Window.partitionBy("recording", "t"))
    out = d.withColumn("scale", scale).withColumn("free", F.when(F.exp("scale") > 1e-12, F.col("d") / F.exp("scale")))
    return out.groupBy("recording", "bone").agg(F.count(F.lit(1)).alias("n"), R(F.avg("scale")).alias("scale"), R(F.avg("free")).alias("free"))


def held_out_rate(spark, sf_dir):
    """Violations on bones that a correction never saw: it is constrained by one half of the body and judged on the other.

    References come from the uncorrected poses and stay, so a pose cannot pass by having shrunk.
    """
    pose = durable(a.pose(spark, sf_dir))
    ref = durable(g.bone_lengths(pose).groupBy("recording", "bone").agg(F.percentile("d", 0.9).alias("l_hat")))
    reach, out = ref.select("recording", "bone", (F.col("l_hat") * (1 + qgeo.EPS)).alias("r")), None
    broken = lambda p, name: g.violations(g.bone_lengths(p), ref, qgeo.EPS).where(F.col("bone").isin(*HALVES[name]))
    for own, other in (("front", "back"), ("back", "front")):
        after = g.corrected(pose, broken(pose, own), reach, {k: g.BONES[k] for k in HALVES[own]})
        frames = lambda p, c: broken(p, other).groupBy("recording", "t").agg(F.bool_or("viol").cast("int").alias(c))  # noqa: B023, E731
        both = frames(pose, "before").join(frames(after, "after"), ["recording", "t"])
        one = both.agg(F.count(F.lit(1)).alias("n"), F.avg("before").alias("before"), F.avg("after").alias("after")).withColumns({"constrained": F.lit(own), "evaluated": F.lit(other)})
        out = one if out is None else out.unionByName(one)
    return out.select("constrained", "evaluated", "n", R("before").alias("before"), R("after").alias("after"), R(F.try_divide(F.col("before") - F.col("after"), F.col("before"))).alias("relative_fall"))


def clean_mask(spark, sf_dir):
    """Share of frames that each of four instruments passes, and that all do."""
    viol = qgeo.violations_mask(spark, sf_dir)
    kp = a.keypoints(a.pose(spark, sf_dir)).groupBy("recording", "t").agg(F.min("conf").alias("conf"), F.bool_or("missing").alias("missing"))
    spike = qgeo.continuity_spike_step(spark, sf_dir).groupBy("recording", "t").agg(F.max("spike").alias("spike"))
    df = kp.join(viol, ["recording", "t"]).join(spike, ["recording", "t"], "left")
    ok = {"bones": ~F.col("violated"), "present": ~F.col("missing"), "smooth": F.coalesce(F.col("spike") <= 2.0, F.lit(True)), "sure": F.col("conf") >= 0.01}
    every = ok["bones"] & ok["present"] & ok["smooth"] & ok["sure"]
    return df.groupBy("recording").agg(F.count(F.lit(1)).alias("n"), *[R(F.avg(c.cast("int"))).alias(k) for k, c in ok.items()], R(F.avg(every.cast("int"))).alias("clean"))


def keypoint_summary(spark, sf_dir):
    """Spikes described per keypoint and (k null) pooled."""
    s = durable(qgeo.continuity_spike_step(spark, sf_dir).select("k", "spike"))
    out = s.rollup("k").agg(F.count(F.lit(1)).alias("n"), R(F.avg((F.col("spike") > 0.1).cast("int"))).alias("over"))
    probs = {"median": 0.5, "p90": 0.9}
    found = rk.quantiles_by(s, "spike", probs, ["k"]).unionByName(rk.quantiles_by(s, "spike", probs).withColumn("k", F.lit(None).cast("int")))
    out = out.join(found.withColumnRenamed("k", "_k"), F.col("k").eqNullSafe(F.col("_k")), "left")
    return out.select("k", "n", R("median", 4).alias("median"), R("p90", 4).alias("p90"), "over")


def component_spread(spark, sf_dir):
    """Deviation of each component of the bank's vectors: live ones vary, dead ones are zero throughout."""
    b = a.bank(spark, sf_dir).select(F.posexplode("vec").alias("i", "x"))
    sd = F.stddev_pop("x")
    return b.groupBy("i").agg(R(sd).alias("sd"), (sd > 1e-9).alias("live"), (F.max(F.abs("x")) == 0).alias("dead"))


def strata(spark, sf_dir):
    """Frames of each split by quintile of the signal on the tuning animals, with the states that a stratum gets; -1: no signal."""
    f = a.frames(spark, sf_dir)
    cuts = gs.quantiles(f.where("split = 'tune'"), "x", [i / N_STRATA for i in range(1, N_STRATA)])
    at = F.when(F.col("x").isNull() | F.isnan("x"), -1).otherwise(sum(((F.col("x") >= c).cast("int") for c in cuts), F.lit(0)))
    states = F.element_at(F.array(*[F.lit(n) for n in allocate(N_STATES, N_STRATA)]), F.col("stratum") + 1)
    out = f.select("split", at.cast("int").alias("stratum")).groupBy("split", "stratum").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("states", F.when(F.col("stratum") >= 0, states))


def run_quintiles(spark, sf_dir):
    """Runs by quintile of their mean signal: count and mean duration."""
    f = a.frames(spark, sf_dir)
    starts = qo.runs(spark, sf_dir).select("recording", F.col("start_t").alias("t"), "run_id")
    upto = _w().rowsBetween(Window.unboundedPreceding, 0)
    f = f.join(starts, ["recording", "t"], "left").withColumn("run", F.last("run_id", True).over(upto))
    r = f.groupBy("recording", "run").agg(R(F.avg("x"), 9).alias("mean"), F.count(F.lit(1)).alias("duration"))
    cuts = gs.quantiles(r, "mean", [0.2, 0.4, 0.6, 0.8])
    q = sum(((F.col("mean") >= c).cast("int") for c in cuts), F.lit(0)).cast("int")
    return r.groupBy(q.alias("quintile")).agg(F.count(F.lit(1)).alias("runs"), R(F.avg("duration")).alias("duration"))


def hazard_shape(spark, sf_dir):
    """Raw hazard by bin of the two busiest states (a top-k report)."""
    p = qe.prepared(spark, sf_dir)
    busy = p.groupBy("code").agg(F.count(F.lit(1)).alias("runs")).orderBy(F.desc("runs"), "code").limit(2)
    return qe.hazard_table(spark, sf_dir).join(busy, "code").select("code", "bin", "at_risk", "exits", R(F.try_divide(F.col("exits"), F.col("at_risk"))).alias("raw"))


def rate_curve(spark, sf_dir):
    """Boundaries a second of each recording at eight thresholds: peaks off abstained frames, the tallest within the gap."""
    d = durable(qs._d(spark, sf_dir).select("recording", "t", "code", "d"))
    med = d.groupBy("recording").agg(F.percentile("d", 0.5).alias("med"), F.count(F.lit(1)).alias("frames"))
    mad = durable(d.join(med, "recording").groupBy("recording", "med", "frames").agg(F.percentile(F.abs(F.col("d") - F.col("med")), 0.5).alias("mad")))
    k = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("k")) for i, x in enumerate(LEVELS)])).alias("l")
    peak = d.withColumns({"p": F.lag("d").over(_w()), "q": F.lead("d").over(_w())}).where("d >= p and d > q and code <> -1")
    over = peak.join(mad, "recording").select("recording", "t", "d", "med", "mad", k).where("d > med + l.k * 1.4826 * (mad + 1e-12)")
    # A recording at one threshold is a sequence of its own.
    kept = qs.s.suppress(over.select((F.col("recording") * len(LEVELS) + F.col("l.i")).alias("recording"), "t", "d"), qs.GAP)
    n = kept.groupBy("recording").agg(F.count(F.lit(1)).alias("n")).select((F.floor(F.col("recording") / len(LEVELS))).alias("recording"), F.pmod("recording", F.lit(len(LEVELS))).cast("int").alias("i"), "n")
    every = mad.select("recording", "frames", k).select("recording", "frames", "l.i", "l.k")
    out = every.join(n, ["recording", "i"], "left")
    return out.select("recording", "k", F.coalesce("n", F.lit(0)).alias("n"), R(F.coalesce("n", F.lit(0)) * FPS / F.col("frames")).alias("rate"))


def run_edge_frames(spark, sf_dir):
    """Distinct frames within two of a run's start or stop, inside the recording."""
    r = qo.runs(spark, sf_dir)
    last = r.groupBy("recording").agg(F.max("end_t").alias("last"))
    edge = r.select("recording", F.explode(F.array("start_t", F.col("end_t"))).alias("e"))
    near = edge.select("recording", F.explode(F.sequence(F.col("e") - TOLERANCE, F.col("e") + TOLERANCE)).alias("t")).distinct()
    return near.join(last, "recording").where("t >= 0 and t <= last").groupBy("recording").agg(F.count(F.lit(1)).alias("n"))


def trial_ids(spark, sf_dir):
    """Opaque ids of each customer's trials: a salted hash of arm, type and number."""
    o = a.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("arm"), F.col("o_orderpriority").alias("ttype"), F.col("o_orderkey").alias("index"))
    return o.select("index", F.substring(F.md5(F.concat_ws("|", F.lit(SALT), "arm", "ttype", F.col("index").cast("string"))), 1, 12).alias("trial"))


def composition(spark, sf_dir):
    """Of each component: its animals' counts and their share of it, the eight largest (a top-k report)."""
    c = qs.clump_components(spark, sf_dir).join(a.bank(spark, sf_dir).select("unit", "animal"), "unit")
    n = c.groupBy("component", "animal").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("component")
    out = n.withColumns({"share": F.col("n") / F.sum("n").over(w), "place": F.row_number().over(w.orderBy(F.desc("n"), "animal"))})
    return out.where("place <= 8").select("component", "animal", "n", R("share").alias("share"))


def arm_ranking(spark, sf_dir):
    """Arms by the share of the raw error that they remove, best first."""
    i = qm.injection_repair(spark, sf_dir)
    raw = i.where("arm = 'raw'").select(F.col("left_error").alias("raw"))
    out = i.crossJoin(F.broadcast(raw)).select("arm", R(F.coalesce(1 - F.try_divide(F.col("left_error"), F.col("raw")), F.lit(0.0))).alias("removed"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("removed"), "arm")))  # three arms


def interval_separation(spark, sf_dir):
    """Sign by which two groups' rates are apart: 1 or -1 where their 95% intervals do not meet, else 0; each with the next."""
    r = qg.grouped_rates(spark, sf_dir).select("animal", "rate", (1.96 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))).alias("h"))
    nxt = r.select((F.col("animal") - 1).alias("animal"), F.col("rate").alias("r2"), F.col("h").alias("h2"))
    sign = F.when(F.col("rate") - F.col("h") > F.col("r2") + F.col("h2"), 1).when(F.col("rate") + F.col("h") < F.col("r2") - F.col("h2"), -1).otherwise(0)
    return r.join(nxt, "animal").select("animal", sign.alias("sign"))


def block_labels(spark, sf_dir):
    """Contiguous blocks of a third of a second: how many of them a recording has, and the mean spread within."""
    size = window_frames(1 / 3, odd=False)
    b = a.frames(spark, sf_dir).groupBy("recording", F.floor(F.col("t") / size).alias("block")).agg(F.var_pop("x").alias("v"))
    return b.groupBy("recording").agg(F.count(F.lit(1)).alias("blocks"), R(F.avg("v"), 4).alias("within"))


def boundary_jaccard(spark, sf_dir):
    """Agreement of two raters as sets: matched marks over all distinct ones."""
    p = qs.boundary_match_prf(spark, sf_dir)
    return p.select("clip", R(F.try_divide(F.col("n_m"), F.col("n_a") + F.col("n_b") - F.col("n_m"))).alias("jaccard"))


QUERIES = {f.__name__: f for f in (exp_roundtrip, naive_velocity, naive_reverse_twist, scalefree_lengths, held_out_rate, clean_mask, keypoint_summary, component_spread, strata, run_quintiles, hazard_shape, rate_curve, run_edge_frames, trial_ids, composition, arm_ranking, interval_separation, block_labels, boundary_jaccard)}



def _held_out(own, other):
    """One direction: suspects and discs by the own half's bones, frames judged by the other half's."""
    of = lambda name: ", ".join(map(str, HALVES[name]))
    sus = qgeo._SUSPECT.replace("FROM len JOIN ref USING (recording, bone))", f"FROM len JOIN ref USING (recording, bone) WHERE bone IN ({of(own)}))")
    ends = ", ".join(f"({b}, {k}, {o})" for b in HALVES[own] for k, o in (g.BONES[b], g.BONES[b][::-1]))
    pairs = ", ".join(f"({b}, {g.BONES[b][0]}, {g.BONES[b][1]})" for b in HALVES[other])
    long = lambda rows: f"SELECT p.recording, p.t, bool_or(coalesce(sqrt((p.x - q.x)**2 + (p.y - q.y)**2) / l_hat > {1 + qgeo.EPS}, false))::INT AS v FROM (VALUES {pairs}) b(bone, i, j) JOIN {rows} p ON p.k = b.i JOIN {rows} q ON q.k = b.j AND q.recording = p.recording AND q.t = p.t JOIN ref ON ref.recording = p.recording AND ref.bone = b.bone GROUP BY ALL"
    return f"""WITH RECURSIVE {sus}, en AS (SELECT * FROM (VALUES {ends}) e(bone, k, other)),
dc AS (SELECT s.recording, s.t, s.suspect AS k, list({{px: o.x, py: o.y, r: l_hat * {1 + qgeo.EPS}}}) AS discs FROM sus s JOIN en ON en.k = s.suspect JOIN ref ON ref.recording = s.recording AND ref.bone = en.bone JOIN kp o ON o.recording = s.recording AND o.t = s.t AND o.k = en.other WHERE suspect >= 0 GROUP BY ALL),
go(recording, t, k, step, x, y, discs) AS (SELECT dc.recording, dc.t, dc.k, 0, kp.x, kp.y, discs FROM dc JOIN kp ON kp.recording = dc.recording AND kp.t = dc.t AND kp.k = dc.k
  UNION ALL SELECT recording, t, k, step + 1, CASE WHEN w.e > 1e-9 THEN w.px + (x - w.px) * w.r / greatest(w.e + w.r, 1e-12) ELSE x END, CASE WHEN w.e > 1e-9 THEN w.py + (y - w.py) * w.r / greatest(w.e + w.r, 1e-12) ELSE y END, discs
  FROM (SELECT *, list_max(list_transform(discs, lambda c: {{e: sqrt((x - c.px)**2 + (y - c.py)**2) - c.r, px: c.px, py: c.py, r: c.r}})) AS w FROM go WHERE step < 32) z),
k2 AS (SELECT kp.recording, kp.t, kp.k, coalesce(go.x, kp.x) AS x, coalesce(go.y, kp.y) AS y FROM kp LEFT JOIN go ON go.recording = kp.recording AND go.t = kp.t AND go.k = kp.k AND step = 32),
bf AS ({long("kp")}), af AS ({long("k2")})
SELECT '{own}' AS constrained, '{other}' AS evaluated, count(*) AS n, round(avg(bf.v), 6) AS before, round(avg(af.v), 6) AS after, round((avg(bf.v) - avg(af.v)) / nullif(avg(bf.v), 0), 6) AS relative_fall FROM bf JOIN af USING (recording, t)"""


ORACLE = {
    "exp_roundtrip": _ROUND,
    "naive_velocity": f"""WITH {_TW}, st AS (SELECT recording, t, sqrt((lead(ox) OVER w - ox)**2 + (lead(oy) OVER w - oy)**2) * {FPS} / 0.5 AS naive FROM (SELECT label AS recording, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding[{2 * g.ORIGIN + 1}]::DOUBLE AS ox, embedding[{2 * g.ORIGIN + 2}]::DOUBLE AS oy FROM embeddings) WINDOW w AS (PARTITION BY recording ORDER BY t)),
s AS (SELECT recording, sqrt(v_x**2 + v_y**2) AS speed, naive FROM tw JOIN st USING (recording, t) WHERE v_x IS NOT NULL) SELECT recording, count(*) AS n, round(avg(speed), 4) AS speed, round(avg(naive), 4) AS naive, round(avg(abs(speed - naive)), 4) AS gap FROM s GROUP BY recording""",
    "naive_reverse_twist": f"WITH {_TW}, i AS (SELECT recording, v_x, row_number() OVER w AS i, count(*) OVER (PARTITION BY recording) AS n FROM tw WHERE v_x IS NOT NULL WINDOW w AS (PARTITION BY recording ORDER BY t)) SELECT x.recording, count(*) AS n, round(avg(abs(x.v_x - y.v_x)), 4) AS differs FROM i x JOIN i y ON x.recording = y.recording AND y.i = x.n - x.i + 1 GROUP BY x.recording",
    "scalefree_lengths": f"WITH {qgeo._LEN}, s AS (SELECT *, quantile_cont(ln(d), 0.5) OVER (PARTITION BY recording, t) AS scale FROM len WHERE d > 0) SELECT recording, bone, count(*) AS n, round(avg(scale), 6) AS scale, round(avg(d / exp(scale)), 6) AS free FROM s GROUP BY ALL",
    "held_out_rate": " UNION ALL ".join(f"({_held_out(x, y)})" for x, y in (("front", "back"), ("back", "front"))),
    "clean_mask": f"""WITH {qgeo._MASK}, kk AS (SELECT recording, t, min(conf) AS conf, bool_or(missing) AS missing FROM kp GROUP BY ALL), sp AS (SELECT recording, t, max(spike) AS spike FROM ({qgeo.ORACLE['continuity_spike_step']}) GROUP BY ALL),
f AS (SELECT recording, NOT violated AS bones, NOT missing AS present, coalesce(spike <= 2.0, true) AS smooth, conf >= 0.01 AS sure FROM kk JOIN vm USING (recording, t) LEFT JOIN sp USING (recording, t))
SELECT recording, count(*) AS n, round(avg(bones::INT), 6) AS bones, round(avg(present::INT), 6) AS present, round(avg(smooth::INT), 6) AS smooth, round(avg(sure::INT), 6) AS sure, round(avg((bones AND present AND smooth AND sure)::INT), 6) AS clean FROM f GROUP BY recording""",
    "keypoint_summary": f"SELECT k, count(*) AS n, round(quantile_cont(spike, 0.5), 4) AS median, round(quantile_cont(spike, 0.9), 4) AS p90, round(avg((spike > 0.1)::INT), 6) AS over FROM ({qgeo.ORACLE['continuity_spike_step']}) GROUP BY ROLLUP (k)",
    "component_spread": "SELECT (i - 1)::INT AS i, round(stddev_pop(embedding[i]::DOUBLE), 6) AS sd, stddev_pop(embedding[i]::DOUBLE) > 1e-9 AS live, max(abs(embedding[i]::DOUBLE)) = 0 AS dead FROM embeddings, range(1, 4097) r(i) WHERE i <= len(embedding) GROUP BY i",
    "strata": f"""WITH {a.FRAMES_SQL}, c AS (SELECT quantile_cont(x, [{", ".join(str(i / N_STRATA) for i in range(1, N_STRATA))}]) AS cuts FROM frames WHERE split = 'tune'),
s AS (SELECT split, CASE WHEN x IS NULL OR isnan(x) THEN -1 ELSE len(list_filter(cuts, lambda e: e <= x)) END::INT AS stratum FROM frames, c)
SELECT split, stratum, count(*) AS n, CASE WHEN stratum >= 0 THEN {allocate(N_STATES, N_STRATA)}[stratum + 1]::INT END AS states FROM s GROUP BY ALL""",
    "run_quintiles": f"""WITH {qo.RUNS_SQL}, m AS (SELECT r.recording, r.run_id, round(avg(f.x), 9) AS mean, count(*) AS duration FROM runs r JOIN frames f ON f.recording = r.recording AND f.t BETWEEN r.start_t AND r.start_t + r.duration - 1 GROUP BY ALL),
c AS (SELECT quantile_cont(mean, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM m) SELECT len(list_filter(cuts, lambda e: e <= mean))::INT AS quintile, count(*) AS runs, round(avg(duration), 6) AS duration FROM m, c GROUP BY 1""",
    "hazard_shape": f"WITH {qe._PREP}, b AS (SELECT code, count(*) AS runs FROM p GROUP BY code ORDER BY runs DESC, code LIMIT 2) SELECT h.code, bin, at_risk, exits, round(exits / nullif(at_risk, 0), 6) AS raw FROM ({qe.ORACLE['hazard_table']}) h JOIN b USING (code)",
    "rate_curve": f"""WITH RECURSIVE {qs._D}, md AS (SELECT recording, quantile_cont(d, 0.5) AS med, count(*) AS frames FROM d GROUP BY 1), m2 AS (SELECT recording, any_value(med) AS med, any_value(frames) AS frames, quantile_cont(abs(d - med), 0.5) AS mad FROM d JOIN md USING (recording) GROUP BY 1),
kk AS (SELECT unnest([{", ".join(map(str, LEVELS))}])::DOUBLE AS k),
pk AS (SELECT p.recording, k, t, d FROM (SELECT recording, t, code, d, lag(d) OVER w AS pa, lead(d) OVER w AS pb FROM d WINDOW w AS (PARTITION BY recording ORDER BY t)) p JOIN m2 USING (recording), kk WHERE d >= pa AND d > pb AND code <> -1 AND d > med + k * 1.4826 * (mad + 1e-12)),
rk AS (SELECT *, row_number() OVER (PARTITION BY recording, k ORDER BY d DESC, t) AS r FROM pk),
go(recording, k, r, kept) AS (SELECT recording, k, 1::BIGINT, [t] FROM rk WHERE r = 1
  UNION ALL SELECT go.recording, go.k, rk.r, CASE WHEN len(list_filter(go.kept, lambda x: abs(x - rk.t) < {qs.GAP})) = 0 THEN list_append(go.kept, rk.t) ELSE go.kept END FROM go JOIN rk ON rk.recording = go.recording AND rk.k = go.k AND rk.r = go.r + 1),
n AS (SELECT recording, k, max(len(kept)) AS n FROM go GROUP BY ALL)
SELECT m2.recording, kk.k, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) * {FPS} / frames, 6) AS rate FROM m2 CROSS JOIN kk LEFT JOIN n ON n.recording = m2.recording AND n.k = kk.k""",
    "trial_ids": f"SELECT o_orderkey AS index, substr(md5('{SALT}|' || o_orderstatus || '|' || o_orderpriority || '|' || o_orderkey), 1, 12) AS trial FROM orders",
    "run_edge_frames": f"WITH {qo.RUNS_SQL}, l AS (SELECT recording, max(end_t) AS last FROM runs GROUP BY 1), e AS (SELECT DISTINCT recording, e + d AS t FROM (SELECT recording, unnest([start_t, end_t]) AS e FROM runs), range({-TOLERANCE}, {TOLERANCE + 1}) r(d)) SELECT recording, count(*) AS n FROM e JOIN l USING (recording) WHERE t >= 0 AND t <= last GROUP BY recording",
    "composition": f"WITH n AS (SELECT component, label AS animal, count(*) AS n FROM ({qs.ORACLE['clump_components']}) c JOIN embeddings ON vec_id = unit GROUP BY ALL) SELECT component, animal, n, round(n / sum(n) OVER (PARTITION BY component), 6) AS share FROM n QUALIFY row_number() OVER (PARTITION BY component ORDER BY n DESC, animal) <= 8",
    "arm_ranking": f"WITH i AS ({qm.ORACLE['injection_repair']}), r AS (SELECT arm, round(coalesce(1 - left_error / (SELECT nullif(left_error, 0) FROM i WHERE arm = 'raw'), 0), 6) AS removed FROM i) SELECT arm, removed, row_number() OVER (ORDER BY removed DESC, arm)::INT AS place FROM r",
    "interval_separation": f"WITH r AS (SELECT animal, rate, 1.96 * sqrt(rate * (1 - rate) / n) AS h FROM ({qg.ORACLE['grouped_rates']})) SELECT x.animal, CASE WHEN x.rate - x.h > y.rate + y.h THEN 1 WHEN x.rate + x.h < y.rate - y.h THEN -1 ELSE 0 END AS sign FROM r x JOIN r y ON y.animal = x.animal + 1",
    "block_labels": f"WITH {a.FRAMES_SQL}, b AS (SELECT recording, t // {window_frames(1 / 3, odd=False)} AS block, var_pop(x) AS v FROM frames GROUP BY ALL) SELECT recording, count(*) AS blocks, round(avg(v), 4) AS within FROM b GROUP BY recording",
    "boundary_jaccard": f"SELECT clip, round(n_m / nullif(n_a + n_b - n_m, 0), 6) AS jaccard FROM ({qs.ORACLE['boundary_match_prf']})",
}
