"""Intervals of recordings: fits by differences of prefix sums, windows of matched lengths, and how found edges cover planted runs.

Prefix sums make every interval two look-ups: a polynomial fit over any interval, or the number of marks in one, is a
difference of two rows, however long it is and however many intervals overlap. Windows are placed by inverse sampling over
what is feasible, never by trying.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.operators import ranking
from seamline.operators.resample import draw

#: Values become whole numbers of 1 / ``UNIT``, so that prefix sums and their differences are exact.
UNIT = 1_000_000
WHOLE = "decimal(38,0)"


def prefix_moments(frames: DataFrame, value: str) -> DataFrame:
    """(recording, t, m0, m1, m2, m3, s2): sums of t^k v and v^2 over the frames before t, in whole units; one more row ends a recording.

    Frames are numbered from 0 without gaps. Sums are exact up to a million frames of values under a thousand; beyond 38 digits Spark refuses.
    """
    v, t = F.round(F.col(value) * UNIT).cast(WHOLE), F.col("t").cast(WHOLE)
    terms = {"m0": v, "m1": v * t, "m2": v * t * t, "m3": v * t * t * t, "s2": v * v}
    df = frames.select("recording", "t", *[c.cast(WHOLE).alias(k) for k, c in terms.items()])
    ends = df.groupBy("recording").agg((F.max("t") + 1).alias("t"), *[F.lit(0).cast(WHOLE).alias(k) for k in terms])
    w = Window.partitionBy("recording").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0)).cast(WHOLE).alias(c)
    return df.unionByName(ends).select("recording", "t", *[before(c) for c in terms])


def interval_fit(moments: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds n, r2 and r2_adj of a cubic over frames start to stop (exclusive); intervals under five frames, and without spread, have none.

    With n steps about the middle, doubled to stay whole (c = 2t - start - stop + 1), the polynomials 1, c, c^2 - (n^2 - 1) / 3
    and c^3 - c (3 n^2 - 7) / 5 are orthogonal, and their own sums of squares are closed forms of n.
    """
    at = lambda p, key: moments.select("recording", F.col("t").alias(key), *[F.col(c).alias(f"{p}{c}") for c in ("m0", "m1", "m2", "m3", "s2")])
    df = intervals.join(at("_a", "start"), ["recording", "start"], "left").join(at("_b", "stop"), ["recording", "stop"], "left")
    m0, m1, m2, m3, s2 = ((F.col(f"_b{c}") - F.col(f"_a{c}")).cast(WHOLE) for c in ("m0", "m1", "m2", "m3", "s2"))
    n, mid = (F.col("stop") - F.col("start")).cast(WHOLE), (F.col("start") + F.col("stop") - 1).cast(WHOLE)
    whole = lambda c: c.cast(WHOLE)
    c1 = whole(2 * m1 - whole(mid * m0))
    c2 = whole(4 * m2 - whole(4 * whole(mid * m1)) + whole(whole(mid * mid) * m0))
    c3 = whole(8 * m3 - whole(12 * whole(mid * m2)) + whole(6 * whole(whole(mid * mid) * m1)) - whole(whole(whole(mid * mid) * mid) * m0))
    p2, p3 = whole(3 * c2 - whole(whole(n * n - 1) * m0)), whole(5 * c3 - whole(whole(3 * n * n - 7) * c1))
    sst = whole(whole(n * s2) - whole(m0 * m0))
    df = df.select(*intervals.columns, *[c.cast("double").alias(k) for k, c in (("n", n), ("_c1", c1), ("_p2", p2), ("_p3", p3), ("_sst", sst))])
    k = F.col("n")
    q1 = k * (k**2 - 1) / 3
    q2 = k * (k**2 - 1) * (k**2 - 4) * 4 / 5  # of 3 c^2 - (n^2 - 1)
    q3 = k * (k**2 - 1) * (k**2 - 4) * (k**2 - 9) * 4 / 7  # of 5 c^3 - c (3 n^2 - 7)
    explained = F.try_divide(F.col("_c1") ** 2, q1) + F.try_divide(F.col("_p2") ** 2, q2) + F.try_divide(F.col("_p3") ** 2, q3)
    r2 = F.when(k >= 5, F.try_divide(explained * k, F.col("_sst")))
    return df.select(*intervals.columns, k.cast("long").alias("n"), r2.alias("r2"), (1 - (1 - r2) * (k - 1) / (k - 4)).alias("r2_adj"))


def length_matched_control(frames: DataFrame, fitted: DataFrame, value: str, n_draws: int, seed: int = 0) -> DataFrame:
    """Per recording: n_compared, wins, win_rate and mean_delta of fitted intervals against drawn ones of the same length and recording.

    ``fitted``: recording, start, stop, the frames that are fitted. Intervals as long as their recording, and fits without a number, are not compared.
    """
    moments = prefix_moments(frames, value)
    size = frames.groupBy("recording").agg(F.count(F.lit(1)).alias("_n"))
    own = interval_fit(moments, fitted.select("recording", "start", "stop")).join(size, "recording").where("n >= 5 and _n > n")
    k = F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))
    drawn = own.select("recording", F.col("start").alias("_of"), F.col("n").alias("_len"), F.col("r2_adj").alias("_own"), "_n", k.alias("_k"))
    at = F.pmod(draw(seed, F.col("recording"), F.col("_of"), F.col("_k")), F.col("_n") - F.col("_len"))
    drawn = drawn.withColumn("start", at.cast("long")).withColumn("stop", F.col("start") + F.col("_len"))
    both = interval_fit(moments, drawn).where("r2_adj is not null and _own is not null")
    won = (F.col("_own") > F.col("r2_adj")).cast("int")
    return both.groupBy("recording").agg(F.count(F.lit(1)).alias("n_compared"), F.sum(won).cast("long").alias("wins"), F.avg(won).alias("win_rate"), F.avg(F.col("_own") - F.col("r2_adj")).alias("mean_delta"))


def under(points: DataFrame, marks: DataFrame, by: list[str], at: str, mark: str, carry: dict[str, Column]) -> DataFrame:
    """As-of join: each point gets ``carry`` (column to aggregate over marks at or under it), by one sort of both, and no join on ranges."""
    here = points.select(*points.columns, F.col(at).alias("_x"), F.lit(1).alias("_side"))
    there = marks.select(*by, *[c for c in marks.columns if c not in by and c not in points.columns], F.col(mark).alias("_x"), F.lit(0).alias("_side"))
    both = here.unionByName(there, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.select(*points.columns, "_side", *[c.over(w).alias(k) for k, c in carry.items()]).where("_side = 1").drop("_side")


def _classes(lengths: DataFrame) -> DataFrame:
    """(length, many) to these with the number of rows in classes before: a row per distinct length."""
    before = F.coalesce(F.sum("many").over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lengths.withColumn("before", before)


def matched_windows(islands: DataFrame, durations: DataFrame, n_target: int, seed: int = 0) -> DataFrame:
    """(draw, recording, start, stop, n_frames): windows inside islands, their lengths drawn from ``durations`` (n_frames).

    A draw takes a length in proportion to how often it occurs, then one of all starts at which a window of it fits into an
    island (recording, start, stop; clean stretches inside one recording), each as likely. Islands of one length are a class: which
    class, which island of it and which offset follow from one number by counting, so no window is tried and none is
    rejected. A length that fits nowhere gives no window.
    """
    spark = islands.sparkSession
    lengths = _classes(durations.groupBy(F.col("n_frames").alias("length")).agg(F.count(F.lit(1)).alias("many")))
    total = durations.agg(F.count(F.lit(1)).alias("_all"))
    u = lambda what: draw(seed, F.lit(what), F.col("draw")) / 2.0**32
    draws = spark.range(n_target).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total)).where("_all > 0")  # one row
    draws = draws.withColumn("_at", F.floor(u("length") * F.col("_all"))).withColumn("_one", F.lit(1))
    got = under(draws, lengths.withColumn("_one", F.lit(1)), ["_one"], "_at", "before", {"n_frames": F.last("length", True)}).select("draw", "n_frames")

    placed = ranking.placed(islands.withColumn("_len", F.col("stop") - F.col("start")), ["recording", "start"], ["_len"], place="_place")
    kinds = islands.groupBy((F.col("stop") - F.col("start")).alias("_len")).agg(F.count(F.lit(1)).alias("_many"))
    wanted = got.select("n_frames").distinct()
    fits = wanted.join(kinds, F.col("_len") >= F.col("n_frames")).withColumn("_room", F.col("_len") - F.col("n_frames") + 1)  # distinct lengths twice
    order = Window.partitionBy("n_frames").orderBy("_len")
    fits = fits.withColumn("_before", F.coalesce(F.sum(F.col("_room") * F.col("_many")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    room = fits.groupBy("n_frames").agg(F.sum(F.col("_room") * F.col("_many")).alias("_rooms"))
    spot = got.join(room, "n_frames").withColumn("_k", F.floor(u("place") * F.col("_rooms")).cast("long"))
    spot = under(spot, fits, ["n_frames"], "_k", "_before", {c: F.last(c, True) for c in ("_len", "_room", "_before")})
    spot = spot.withColumns({"_rest": F.col("_k") - F.col("_before")}).withColumns({"_place": F.expr("_rest div _room"), "_off": F.expr("_rest % _room")})
    out = spot.join(placed.select("_len", "_place", "recording", F.col("start").alias("_start")), ["_len", "_place"])
    start = F.col("_start") + F.col("_off")
    return out.select("draw", "recording", start.alias("start"), (start + F.col("n_frames")).alias("stop"), "n_frames")


def classify(planted: DataFrame, peaks: DataFrame, rows: DataFrame, tol: int) -> DataFrame:
    """Each planted run (recording, start, stop) in one class: isolated, no_edge, one_edge, split or merged.

    ``isolated``: a found segment (``rows``) has both its ends within ``tol``; otherwise by the peaks near its ends and strictly
    inside. Peaks are counted by prefix sums at four places of a run, segments met through buckets of the tolerance's size.
    """
    ranked = peaks.select("recording", F.col("t").cast("long").alias("t"))
    spots = {"_s0": F.col("start") - tol - 1, "_s1": F.col("start") + tol, "_e0": F.col("stop") - tol - 1, "_e1": F.col("stop") + tol}
    df = planted.select("recording", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    long = df.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("x")) for k, v in spots.items()])).alias("p")).select("recording", "start", "stop", "p.k", "p.x")
    seen = under(long, ranked.withColumn("_peak", F.lit(1)), ["recording"], "x", "t", {"n": F.count("_peak")})
    counts = seen.groupBy("recording", "start", "stop").agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in spots])
    size = tol + 1
    near = rows.select("recording", F.col("start").alias("_rs"), F.col("stop").alias("_re"), F.explode(F.array(*[F.floor(F.col("start") / size) + i for i in (-1, 0, 1)])).alias("_b"))
    hit = df.withColumn("_b", F.floor(F.col("start") / size)).join(near, ["recording", "_b"]).where((F.abs(F.col("start") - F.col("_rs")) <= tol) & (F.abs(F.col("stop") - F.col("_re")) <= tol))
    hit = hit.select("recording", "start", "stop", F.lit(True).alias("_exact")).distinct()
    has_s, has_e, inside = F.col("_s1") > F.col("_s0"), F.col("_e1") > F.col("_e0"), F.col("_e0") > F.col("_s1")
    bins = F.when(F.col("_exact"), "isolated").when(~has_s & ~has_e, "no_edge").when(has_s != has_e, "one_edge").when(inside, "split").otherwise("merged")
    return counts.join(hit, ["recording", "start", "stop"], "left").select("recording", "start", "stop", bins.alias("found"))
