"""Geometry of tracked keypoints: lengths, references, masks, body frame, relative motion, similarity predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keypoints in order; the axis runs from tail base to nose.
NOSE, TAIL, ORIGIN = 0, 6, 3
BONES = ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6))
SMALL_ANGLE = 1e-4


def finite(c: Column) -> Column:
    """NaN and infinities to NULL, so that comparisons with them are not true and averages skip them."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2)


def bone_lengths(pose: DataFrame, pairs=BONES) -> DataFrame:
    """Long form (recording, t, bone, i, j, d)."""
    items = F.array(*[F.struct(F.lit(b).alias("bone"), F.lit(i).alias("i"), F.lit(j).alias("j"), distance(F.get("pose", i), F.get("pose", j)).alias("d")) for b, (i, j) in enumerate(pairs)])
    return pose.select("recording", "t", F.explode(items).alias("b")).select("recording", "t", "b.*")


def all_pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


def rigid_pairs(lengths: DataFrame, by: str = "recording") -> DataFrame:
    """Pairs of a group whose spread of log length (1.4826 * MAD) is at most the median spread of its pairs."""
    logs = lengths.where("d > 0").withColumn("logd", F.log("d"))
    med = logs.groupBy(by, "bone").agg(F.percentile("logd", 0.5).alias("med"))
    mad = logs.join(med, [by, "bone"]).groupBy(by, "bone").agg((1.4826 * F.percentile(F.abs(F.col("logd") - F.col("med")), 0.5)).alias("mad"), F.count(F.lit(1)).alias("n"))
    mad = mad.where("n >= 3")
    cut = mad.groupBy(by).agg(F.percentile("mad", 0.5).alias("cut"))
    return mad.join(cut, by).where("mad <= cut").select(by, "bone", "mad")


def reference_length(lengths: DataFrame, eps: float, by: str = "recording", pct: float = 0.99, rounds: int = 3) -> DataFrame:
    """Trimmed upper percentile per group and bone: the percentile again over values up to it times 1 + eps, ``rounds`` times."""
    ref = lengths.groupBy(by, "bone").agg(F.percentile("d", pct).alias("l_hat"), F.count("d").alias("n")).where("n >= 10").drop("n")
    for _ in range(rounds):
        kept = lengths.join(ref, [by, "bone"]).where(F.col("d") <= F.col("l_hat") * (1 + eps))
        ref = kept.groupBy(by, "bone").agg(F.percentile("d", pct).alias("l_hat"))
    return ref


def violations(lengths: DataFrame, ref: DataFrame, eps: float, by: str = "recording") -> DataFrame:
    """Adds viol: the length exceeds its reference by more than eps; what cannot be measured does not."""
    return lengths.join(ref, [by, "bone"], "left").withColumn("viol", F.coalesce(finite(F.col("d")) / F.col("l_hat") > 1 + eps, F.lit(False)))


def attribution(viol: DataFrame) -> DataFrame:
    """Per keypoint: frames with a violating bone at it, and its share of all blame (each bone blames both ends)."""
    blame = viol.where("viol").select("recording", "t", F.explode(F.array("i", "j")).alias("k"))
    total = blame.agg(F.count(F.lit(1)).alias("total"))
    per = blame.groupBy("k").agg(F.count_distinct("recording", "t").alias("frames"), F.count(F.lit(1)).alias("blamed"))
    return per.crossJoin(F.broadcast(total)).select("k", "frames", (F.col("blamed") / F.col("total")).alias("share"))  # one-row total


def heading(axis_from: Column, axis_to: Column) -> Column:
    return F.atan2(axis_to["y"] - axis_from["y"], axis_to["x"] - axis_from["x"])


def wrap(angle: Column) -> Column:
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def egocentric(pose: DataFrame, ell: Column) -> DataFrame:
    """Adds theta and ego: keypoints moved to the origin keypoint, turned by the heading, in body lengths."""
    o, c, s = F.get("pose", ORIGIN), F.cos("theta"), F.sin("theta")
    df = pose.withColumn("theta", heading(F.get("pose", TAIL), F.get("pose", NOSE)))
    turn = lambda p: F.struct(
        ((c * (p["x"] - o["x"]) + s * (p["y"] - o["y"])) / ell).alias("x"), ((c * (p["y"] - o["y"]) - s * (p["x"] - o["x"])) / ell).alias("y")
    )
    return df.withColumn("ego", F.transform("pose", turn))


def se2_log(dtheta: Column, ux: Column, uy: Column) -> tuple[Column, Column, Column]:
    """Constant twist whose motion over one frame is the given rotation and translation."""
    half = dtheta / 2
    small = F.abs(dtheta) < SMALL_ANGLE
    cot = F.when(small, 1 - dtheta * dtheta / 12).otherwise(half / F.tan(F.when(small, F.lit(1.0)).otherwise(half)))
    return cot * ux + half * uy, cot * uy - half * ux, dtheta


def twist(pose: DataFrame, ell: Column, fps: float = 30.0) -> DataFrame:
    """Adds v_x, v_y (body lengths a second) and omega (radians a second) to the next frame; NULL on a recording's last."""
    w = Window.partitionBy("recording").orderBy("t")
    df = pose.withColumn("theta", heading(F.get("pose", TAIL), F.get("pose", NOSE))).withColumn("o", F.get("pose", ORIGIN))
    n = F.lead(F.struct("theta", "o")).over(w)
    df = df.withColumn("_n", n)
    dx, dy = F.col("_n.o.x") - F.col("o.x"), F.col("_n.o.y") - F.col("o.y")
    c, s = F.cos("theta"), F.sin("theta")
    vx, vy, om = se2_log(wrap(F.col("_n.theta") - F.col("theta")), c * dx + s * dy, c * dy - s * dx)
    return df.withColumns({"v_x": vx * fps / ell, "v_y": vy * fps / ell, "omega": om * fps}).drop("_n", "o")


def leave_one_out(pose: DataFrame, shift: int) -> DataFrame:
    """Residual of each keypoint against the similarity that carries the other keypoints of a neighbour frame onto this one.

    Closed form: with centred points a (neighbour) and b, the similarity is the complex ratio sum(conj(a) b) / sum(|a|^2).
    The sums without a keypoint are the frame's sums less the keypoint's own terms.
    """
    w = Window.partitionBy("recording").orderBy("t")
    df = pose.withColumn("other", F.lead("pose", shift).over(w) if shift > 0 else F.lag("pose", -shift).over(w)).where("other is not null")
    df = df.select("recording", "t", F.posexplode(F.arrays_zip("other", "pose")).alias("k", "z"))
    df = df.select("recording", "t", "k", *[F.col(f"z.{c}.{ax}").alias(f"{n}{ax}") for c, n in (("other", "a"), ("pose", "b")) for ax in "xy"])
    terms = {
        "n": F.lit(1), "sax": F.col("ax"), "say": F.col("ay"), "sbx": F.col("bx"), "sby": F.col("by"), "saa": F.expr("ax * ax + ay * ay"),
        "sre": F.expr("ax * bx + ay * by"), "sim": F.expr("ax * by - ay * bx"),
    }
    frame = Window.partitionBy("recording", "t")
    df = df.withColumns({name: F.sum(term).over(frame) - term for name, term in terms.items()})
    re = F.expr("sre - (sax * sbx + say * sby) / n")
    im = F.expr("sim - (sax * sby - say * sbx) / n")
    den = F.expr("saa - (sax * sax + say * say) / n")
    df = df.withColumns({"c": F.try_divide(re, den), "s": F.try_divide(im, den)})
    df = df.withColumns({v: F.expr(f"{v} - s{v} / n") for v in ("ax", "ay", "bx", "by")})
    return df.select("recording", "t", "k", F.expr("sqrt(pow(bx - (c * ax - s * ay), 2) + pow(by - (s * ax + c * ay), 2))").alias("residual"))


def spike_step(pose: DataFrame) -> DataFrame:
    """spike = the smaller, step = the difference of the residuals against both neighbours; NULL unless both exist."""
    minus = leave_one_out(pose, -1).withColumnRenamed("residual", "r_minus")
    plus = leave_one_out(pose, 1).withColumnRenamed("residual", "r_plus")
    both = minus.join(plus, ["recording", "t", "k"])
    return both.select("recording", "t", "k", F.least("r_minus", "r_plus").alias("spike"), F.abs(F.col("r_minus") - F.col("r_plus")).alias("step"))


def suspects(viol: DataFrame, pose: DataFrame) -> DataFrame:
    """The keypoint that all violating bones of a frame share: least confident, then first; -1 if none."""
    hit = viol.where("viol").groupBy("recording", "t").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.array("i", "j")).alias("ends"))
    conf = pose.select("recording", "t", "conf")
    df = hit.join(conf, ["recording", "t"])
    common = F.filter(F.array_distinct(F.flatten("ends")), lambda k: F.forall("ends", lambda e: F.array_contains(e, k)))
    best = F.array_min(F.transform(common, lambda k: F.struct(F.get(F.col("conf"), k).alias("c"), k.alias("k"))))
    return df.select("recording", "t", F.col("n").alias("n_bones"), F.coalesce(best["k"], F.lit(-1)).alias("suspect"))


def project(points: DataFrame, rounds: int = 32) -> DataFrame:
    """Move a point into discs: (x, y, discs array<struct<px, py, r>>) gains nx, ny and moved.

    A fold over rounds: the disc that the point is furthest outside of pulls it to its edge, until none is left.
    """
    far = lambda s: F.array_max(
        F.transform(
            "discs",
            lambda c: F.struct(
                (F.sqrt((s["x"] - c["px"]) ** 2 + (s["y"] - c["py"]) ** 2) - c["r"]).alias("e"), c["px"].alias("px"), c["py"].alias("py"), c["r"].alias("r")
            ),
        )
    )

    def step(s, _):
        def pull(w):
            scale, out = w["r"] / F.greatest(w["e"] + w["r"], F.lit(1e-12)), w["e"] > 1e-9
            x, y = w["px"] + (s["x"] - w["px"]) * scale, w["py"] + (s["y"] - w["py"]) * scale
            return F.struct(F.when(out, x).otherwise(s["x"]).alias("x"), F.when(out, y).otherwise(s["y"]).alias("y"))

        # An array of one binds the furthest disc to a name, so that it is found once a round.
        return F.get(F.transform(F.array(far(s)), pull), F.lit(0))

    fold = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.col("x").alias("x"), F.col("y").alias("y")), step)
    out = points.withColumn("_p", fold)
    return out.withColumns({"nx": F.col("_p.x"), "ny": F.col("_p.y"), "moved": F.sqrt((F.col("_p.x") - F.col("x")) ** 2 + (F.col("_p.y") - F.col("y")) ** 2)}).drop("_p")


def corrected(pose: DataFrame, viol: DataFrame, reach: DataFrame, pairs: dict[int, tuple[int, int]], rounds: int = 32) -> DataFrame:
    """Pose whose frames' suspects, by the violations given, are pulled into the discs of the bones given; all else stays.

    ``pairs``: bone to its two keypoints, ``reach``: (recording, bone, r). Only these bones constrain anything.
    """
    spark = pose.sparkSession
    sus = suspects(viol, pose).where("suspect >= 0").select("recording", "t", F.col("suspect").alias("k"))
    ends = spark.createDataFrame([(b, k, o) for b, (i, j) in pairs.items() for k, o in ((i, j), (j, i))], "bone int, k int, other int")
    at = lambda k: F.get("pose", F.col(k))
    near = sus.join(F.broadcast(ends), "k").join(reach, ["recording", "bone"]).join(pose.select("recording", "t", "pose"), ["recording", "t"])  # two rows a bone
    disc = F.struct(at("other")["x"].alias("px"), at("other")["y"].alias("py"), "r")
    points = near.groupBy("recording", "t", "k").agg(F.sort_array(F.collect_list(disc)).alias("discs"), F.first(at("k")["x"]).alias("x"), F.first(at("k")["y"]).alias("y"))  # two bones at most
    moved = project(points, rounds).select("recording", "t", F.col("k").alias("_k"), F.struct(F.col("nx").alias("x"), F.col("ny").alias("y")).alias("_to"))
    out = pose.join(moved, ["recording", "t"], "left")
    return out.withColumn("pose", F.transform("pose", lambda p, i: F.when(i.eqNullSafe(F.col("_k")), F.col("_to")).otherwise(p))).select(*pose.columns)
