"""Matching without replacement, and trial plans built on it.

Deferred acceptance: every target has a list of controls in the order it wants them, every control prefers the nearest target.
In a round each target asks the first control of its list that holds no better offer; a control keeps the best offer it was made. Offers
to a control only get better, so rounds end, with the one matching that is stable and best for the targets whatever the
order of asking. A round is a join of lists with offers and two partial minima; it is written to the checkpoint folder.

Lists are as long as they must be: ``START`` nearest controls at first, found by the pivot index, and four times as many for the
targets left over, until all are matched or the pool was seen whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.operators import ranking, search
from seamline.operators.resample import draw
from seamline.operators.segments import durable

START = 16
SALT = "odd-one-of-three"
TYPES = ("island_pair", "control_pair")


def features(segments: DataFrame) -> DataFrame:
    """Adds vec: logarithms of duration and speed."""
    log = lambda c, least: F.log(F.greatest(F.col(c).cast("double"), F.lit(least)))
    return segments.withColumn("vec", F.array(log("n_frames", 1.0), log("speed", 1e-9)))


def settle(lists: DataFrame, offers: DataFrame | None = None) -> DataFrame:
    """(target, pos, control, cost) to (control, cost, target): the best offer each control was made, at the end.

    ``offers`` starts from an earlier end, whose lists these prolong.
    """
    spark = lists.sparkSession
    lists, offers = durable(lists), offers if offers is not None else spark.createDataFrame([], "control long, cost double, target long")
    while True:
        held = offers.select("control", F.struct("cost", "target").alias("held"))
        open_ = lists.join(held, "control", "left").where(F.col("held").isNull() | (F.struct("cost", "target") <= F.col("held")))
        asks = open_.groupBy("target").agg(F.min(F.struct("pos", "control", "cost")).alias("a")).select("target", "a.control", "a.cost")
        best = asks.unionByName(offers).groupBy("control").agg(F.min(F.struct("cost", "target")).alias("b")).select("control", "b.cost", "b.target")
        best = durable(best)
        if best.exceptAll(offers).isEmpty():
            return best
        offers = best


def match(targets: DataFrame, pool_size: int, lists: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(target, control, cost) of ``targets`` (unit); ``lists`` gives the first k controls of each target."""
    n, k, offers = targets.count(), START, None
    while True:
        offers = settle(lists(targets, k), offers)
        if k >= pool_size or offers.count() == min(n, pool_size):
            return offers.select("target", "control", "cost")
        k = min(4 * k, pool_size)


def nearest_lists(pool: DataFrame, n_near: int = 1, seed: int = 0) -> Callable[[DataFrame, int], DataFrame]:
    """Lists by distance of vec; within each ``n_near`` nearest the order is drawn. Targets may forbid animals (array ``forbid``), and never get their own."""

    def lists(targets: DataFrame, k: int) -> DataFrame:
        near = search.knn(pool, k, targets).withColumnRenamed("query", "target")
        if "forbid" in targets.columns:
            named = near.join(pool.select(F.col("unit").alias("neighbour"), F.col("animal").alias("_a")), "neighbour")
            named = named.join(targets.select(F.col("unit").alias("target"), "forbid"), "target")
            near = named.where(~F.coalesce(F.array_contains("forbid", F.col("_a")), F.lit(False)))
        drawn = draw(seed, F.col("target"), F.col("neighbour")) if n_near > 1 else F.lit(0)
        pos = F.struct(F.floor((F.col("rank") - 1) / n_near).alias("block"), drawn.alias("draw"), F.col("rank"))
        return near.select("target", pos.alias("pos"), F.col("neighbour").alias("control"), F.col("dist").alias("cost"))

    return lists


def drawn_lists(pool: DataFrame, seed: int) -> Callable[[DataFrame, int], DataFrame]:
    """Lists of controls in drawn order: the pool is laid out by draw, each target reads on from a place of its own."""
    laid = durable(ranking.placed(pool.select("unit", "animal", draw(seed, F.lit("pool"), F.col("unit")).alias("_d")), ["_d", "unit"], size="_n"))

    def lists(targets: DataFrame, k: int) -> DataFrame:
        forbid = F.col("forbid") if "forbid" in targets.columns else F.array(F.col("animal"))
        asked = ranking.placed(targets.select(F.col("unit").alias("target"), forbid.alias("forbid"), draw(seed, F.lit("target"), F.col("unit")).alias("_d")), ["_d", "target"], place="_r", size="_q")
        size = laid.agg(F.max("_n").alias("n"))
        steps = asked.crossJoin(F.broadcast(size)).where("n is not null").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("pos < n")  # one row
        at = F.pmod(F.floor(F.col("_r") * F.col("n") / F.col("_q")) + F.col("pos"), F.col("n"))
        met = steps.withColumn("place", at).join(laid.select("place", F.col("unit").alias("control"), F.col("animal").alias("_a"), F.col("_d").alias("_cd")), "place")
        cost = (draw(seed, F.col("target"), F.col("control")) / 2.0**32).alias("cost")
        return met.where(~F.array_contains("forbid", F.col("_a"))).select("target", "pos", "control", cost)

    return lists


def match_controls(targets: DataFrame, pool: DataFrame, n_near: int = 5, seed: int = 0) -> DataFrame:
    """(target, control, cost): each target's control of another animal, no control twice; near in log duration and log speed.

    With ``n_near`` over 1 a target wants the ``n_near`` nearest in a drawn order, then the next ones. A target without any eligible control left has no row.
    """
    t, p = features(targets), durable(features(pool).select("unit", "animal", "vec"))
    return match(t, p.count(), nearest_lists(p, n_near, seed))


def trial_id(arm, kind, index, salt: str = SALT):
    """A name that arm, type and number decide, and the answer does not."""
    return F.concat(F.lit("t"), F.substring(F.sha2(F.concat_ws("|", F.lit(salt), arm, kind, index.cast("string")), 256), 1, 10))


def plan_trials(islands: DataFrame, pool: DataFrame, arm: str, n_trials: int, seed: int = 0, n_near: int = 5) -> DataFrame:
    """One row per trial of an arm: id, arm, type, index, odd_position, odd_is, clips and animals in order of presentation.

    Half of the trials show two islands and a control, half two controls and an island, all of three animals. Islands are paired
    half an order of animals apart, so two of one animal meet only if it holds over half of them; such a trial, and one whose controls run out,
    is left out. ``matched`` controls are near the first island, ``unmatched`` ones drawn. Odd positions are dealt in turn over a drawn order.
    """
    if arm not in ("matched", "unmatched"):
        raise ValueError(f"unknown arm {arm!r}")
    cols = ["unit", "animal", "n_frames", "speed"]
    islands = durable(features(islands.select(*cols)).withColumn("_d", draw(seed, F.lit(arm), F.col("unit"))))
    pool = durable(features(pool.select(*cols)).select("unit", "animal", "vec"))
    each = min(n_trials // 2, islands.count() // 3)
    chosen = islands.orderBy("_d", "unit").limit(3 * each)  # as many as the plan asks for
    chosen = durable(ranking.placed(chosen, ["_d", "unit"]))
    paired = ranking.placed(chosen.where(F.col("place") < 2 * each), ["animal", "_d", "unit"], place="at")
    first, second = (paired.where(w).select((F.col("at") % max(each, 1)).alias("index"), F.col("unit").alias(f"u{k}"), F.col("animal").alias(f"a{k}"), F.col("vec").alias(f"v{k}")) for k, w in ((1, F.col("at") < each), (2, F.col("at") >= each)))
    both = first.join(second, "index").where("a1 <> a2")
    ask = both.select(F.lit(TYPES[0]).alias("type"), "index", F.col("u1").alias("unit"), F.col("u2").alias("mate"), F.col("a1").alias("animal"), F.col("v1").alias("vec"), F.array("a1", "a2").alias("forbid"))
    single = chosen.where(F.col("place") >= 2 * each).select(F.lit(TYPES[1]).alias("type"), (F.col("place") - 2 * each).alias("index"), "unit", F.lit(None).cast("long").alias("mate"), "animal", "vec", F.array("animal").alias("forbid"))
    ask = durable(ask.unionByName(single))
    wanted = lambda p, s: nearest_lists(p, n_near, s) if arm == "matched" else drawn_lists(p, s)
    named = lambda got, c: got.join(pool.select(F.col("unit").alias("control"), F.col("animal").alias(f"{c}_animal")), "control").select(F.col("target").alias("unit"), F.col("control").alias(c), f"{c}_animal")

    got = durable(ask.join(named(match(ask, pool.count(), wanted(pool, seed)), "c1"), "unit"))
    more = got.where(F.col("type") == TYPES[1]).withColumn("forbid", F.array("animal", "c1_animal"))
    rest = durable(pool.join(got.select(F.col("c1").alias("unit")), "unit", "left_anti"))
    other = durable(named(match(more, rest.count(), wanted(rest, seed + 1)), "c2"))

    clip = lambda u, a: F.struct(F.col(u).alias("unit"), F.col(a).alias("animal"))
    islands_of = got.where(F.col("type") == TYPES[0]).join(islands.select(F.col("unit").alias("mate"), F.col("animal").alias("mate_animal")), "mate")
    one = islands_of.select("type", "index", F.lit("control").alias("odd_is"), F.array(clip("unit", "animal"), clip("mate", "mate_animal")).alias("pair"), clip("c1", "c1_animal").alias("odd"))
    two = got.where(F.col("type") == TYPES[1]).join(other, "unit").select("type", "index", F.lit("island").alias("odd_is"), F.array(clip("c1", "c1_animal"), clip("c2", "c2_animal")).alias("pair"), clip("unit", "animal").alias("odd"))
    trials = one.unionByName(two).withColumn("_d", draw(seed, F.lit("position"), F.col("type"), F.col("index")))
    out = ranking.placed(trials, ["_d", "type", "index"]).withColumn("odd_position", (F.col("place") % 3).cast("int"))
    clips = F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: F.when(i == F.col("odd_position"), F.col("odd")).otherwise(F.get("pair", i - F.when(i > F.col("odd_position"), 1).otherwise(0))))
    out = out.withColumn("clips", clips)
    return out.select(
        trial_id(F.lit(arm), F.col("type"), F.col("index")).alias("id"), F.lit(arm).alias("arm"), "type", "index", "odd_position", "odd_is",
        F.transform("clips", lambda c: c["unit"]).alias("clips"), F.transform("clips", lambda c: c["animal"]).alias("animals"),
    )
