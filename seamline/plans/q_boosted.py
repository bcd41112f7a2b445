"""Boosted regression on stacks of causal frames, held out by recording."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seamline.operators import boosting, geometry
from seamline.operators.segments import durable
from seamline.plans import q_geometry as qgeo
from seamline.sources import adapters as a

#: Frames of a stack, the frame's own among them; keypoints whose body coordinates are stacked; folds of recordings.
STACK, POINTS, FOLDS = 5, (geometry.NOSE, geometry.TAIL), 5
SHAPE = boosting.Shape(trees=10, depth=2, bins=16)


def stacks(spark, sf_dir):
    """One row per frame with a full stack behind it: features, speed and turn to the next frame, fold."""
    ego = geometry.egocentric(a.pose(spark, sf_dir), F.lit(0.5))
    w = Window.partitionBy("recording").orderBy("t")
    flat = [F.get("ego", k)[c].alias(f"k{k}{c}") for k in POINTS for c in ("x", "y")]
    rows = ego.select("recording", "t", *flat)
    names = [f"k{k}{c}" for k in POINTS for c in ("x", "y")]
    stacked = [F.lag(c, i).over(w).alias(f"{c}_{i}") for c in names for i in range(STACK)]
    twist = qgeo.twist_se2(spark, sf_dir).select("recording", "t", F.sqrt(F.col("v_x") ** 2 + F.col("v_y") ** 2).alias("speed"), F.col("omega").alias("turn"))
    out = rows.select("recording", "t", F.row_number().over(w).alias("_n"), *stacked).where(F.col("_n") >= STACK).join(twist, ["recording", "t"])
    return out.withColumn("fold", F.pmod("recording", F.lit(FOLDS)).cast("int")), [f"{c}_{i}" for c in names for i in range(STACK)]


def boosted_held_out(spark, sf_dir):
    """Share of the variance of speed and turn that trees on other recordings explain, by fold."""
    rows, features = stacks(spark, sf_dir)
    rows, out = durable(rows), None
    for target in ("speed", "turn"):
        made = boosting.fit(rows, features, target, "fold", FOLDS, SHAPE)
        one = boosting.explained(boosting.held_out(rows, made, target, "fold")).withColumn("target", F.lit(target))
        out = one if out is None else out.unionByName(one)
    return out.select("target", "fold", "n", F.round("r2", 6).alias("r2"))


QUERIES = {"boosted_held_out": boosted_held_out}
