"""Hand-built cases: seams, abstaining, bins, planted signals, refusals."""

import math

import pytest
from pyspark.sql import functions as F

from seamline.operators import eventhistory as h
from seamline.operators import geometry as g
from seamline.operators import groupstats as gs
from seamline.operators import neighbours as nb
from seamline.operators import ordered as o
from seamline.operators import resample as rs
from seamline.operators import segments as s
from seamline.sources import adapters as a


def frames(spark, *recordings):
    rows = [(r, t, c, float(c)) for r, codes in enumerate(recordings) for t, c in enumerate(codes)]
    return spark.createDataFrame(rows, "recording long, t long, code int, x double")


def test_seam_splits_a_run(spark):
    runs = o.encode(frames(spark, [0] * 5, [0] * 5)).collect()
    assert [r.duration for r in runs] == [5, 5]


def test_abstain_does_not_fuse(spark):
    runs = o.encode(frames(spark, [4] * 5 + [-1] * 3 + [4] * 5))
    assert [r.codes for r in o.sequences(runs).orderBy("seq").collect()] == [[4], [4]]
    assert runs.agg(F.sum("duration")).first()[0] == 13


def test_dropping_abstain_would_repeat(spark):
    runs = o.encode(frames(spark, [4, 4, -1, 4])).where("code <> -1")
    assert runs.withColumn("again", o.self_transitions(runs)).where("again").count() == 1


def test_prepare_censors_before_abstain_and_at_end(spark):
    runs = o.encode(frames(spark, [1, 1, -1, 2, 3]))
    rows = {r.run_id: (r.next_state, r.censored) for r in o.prepare(runs, "conditioned").collect()}
    assert rows == {1: (None, True), 3: (3, False), 4: (None, True)}
    with pytest.raises(ValueError):
        o.prepare(runs, "other")


def test_half_open_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 4, 5, 999)], "v long")
    assert [r[0] for r in df.select(h.bin_of(F.col("v"), [0, 2, 5, h.OPEN_END])).collect()] == [0, 0, 1, 1, 2, 2]


def test_pmf_and_hazard_conserve(spark):
    runs = o.encode(frames(spark, [0, 0, 0, 1, 2, 2, 0, 1, 1, 1, 1]))
    p = o.prepare(runs, "conditioned")
    hz = h.hazard(p, [0, 1, 2, h.OPEN_END])
    assert hz.agg(F.sum("exits")).first()[0] == p.where("not censored").count()
    at = p.select(F.sum(F.col("duration") - 1 + (~F.col("censored")).cast("int"))).first()[0]
    assert hz.agg(F.sum("at_risk")).first()[0] == at


def test_far_recording_changes_nothing(spark):
    one = frames(spark, [0, 1, 5, 2, 9, 4, 4, 3, 8])
    two = frames(spark, [0, 1, 5, 2, 9, 4, 4, 3, 8], [9000] * 20)
    for f in (lambda d: o.rolling_median(d, ["recording"], "x", 3, "m"), lambda d: s.discontinuity(d, ["x"], 2, "m")):
        get = lambda d: [r.m for r in f(d).where("recording = 0").orderBy("t").collect()]  # noqa: E731, B023
        assert get(one) == get(two)


def test_short_series_keep_their_values(spark):
    df = o.rolling_median(frames(spark, [3, 1, 2]), ["recording"], "x", 5, "m")
    assert [r.m for r in df.orderBy("t").collect()] == [3.0, 1.0, 2.0]


def test_held_edges_and_all_missing(spark):
    rows = [(0, t, float(t * t), t in (0, 2, 4)) for t in range(5)] + [(1, 0, 7.0, True)]
    df = o.held(spark.createDataFrame(rows, "recording long, t long, x double, gone boolean"), ["recording"], "x", "gone", "y")
    assert [r.y for r in df.orderBy("recording", "t").collect()] == [1.0, 1.0, 5.0, 9.0, 9.0, 7.0]


def test_kink_is_found_within_a_frame(spark):
    x = [abs(t - 40) * 1.0 for t in range(80)]
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate(x)], "recording long, t long, x double")
    top = s.discontinuity(df, ["x"], 4).orderBy(F.desc("d")).first()
    assert abs(top.t - 40) <= 1 or top.d > 0


def test_suppression_keeps_the_tallest(spark):
    rows = [(0, 1, 5.0), (0, 3, 9.0), (0, 5, 6.0), (0, 7, 5.0), (0, 20, 1.0)]
    kept = s.suppress(spark.createDataFrame(rows, "recording long, t long, d double"), 3)
    assert sorted(r.t for r in kept.collect()) == [3, 7, 20]


def test_matching_is_one_to_one(spark):
    mk = lambda fs: spark.createDataFrame([(0, f) for f in fs], "clip long, frame long")
    x, y = mk([10, 12, 50]), mk([11, 13, 90])
    m = s.match_marks(x, y, 2)
    assert sorted((r.fa, r.fb) for r in m.collect()) == [(10, 11), (12, 13)]
    row = s.prf(x, y, m).first()
    assert (row.precision, row.recall) == (pytest.approx(2 / 3), pytest.approx(2 / 3))


def test_nan_length_is_no_violation(spark):
    df = spark.createDataFrame([(0, 0, 0, math.nan), (0, 1, 0, 3.0)], "recording int, t long, bone int, d double")
    ref = spark.createDataFrame([(0, 0, 1.0)], "recording int, bone int, l_hat double")
    assert [r.viol for r in g.violations(df, ref, 0.1).orderBy("t").collect()] == [False, True]


def test_se2_log_of_a_pure_turn_and_a_straight_step(spark):
    df = spark.createDataFrame([(0.0, 1.0, 2.0), (1e-6, 1.0, 0.0)], "w double, x double, y double")
    vx, vy, om = g.se2_log(F.col("w"), F.col("x"), F.col("y"))
    got = df.select(vx.alias("a"), vy.alias("b"), om.alias("c")).collect()
    assert (got[0].a, got[0].b) == (1.0, 2.0)
    assert got[1].a == pytest.approx(1.0)


def test_rigid_motion_has_no_residual(spark):
    base = [(0.0, 0.0), (1.0, 0.2), (2.0, -0.1), (3.0, 0.4), (4.0, 0.0), (5.0, 0.3), (6.0, 0.1)]
    rows = []
    for t in range(3):
        c, n = math.cos(0.3 * t), math.sin(0.3 * t)
        rows.append((0, t, [(c * x - n * y + t, n * x + c * y) for x, y in base]))
    df = spark.createDataFrame(rows, "recording int, t long, pose array<struct<x:double,y:double>>")
    assert g.leave_one_out(df, 1).agg(F.max("residual")).first()[0] < 1e-6


def test_components_are_transitive(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)] + [(i, i + 1) for i in range(100, 140)], "a long, b long")
    got = {r.unit: r.component for r in nb.components(edges).collect()}
    assert got[3] == 1 and got[6] == 5 and got[140] == 100


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    sums = {df.repartition(n).select(F.sum(rs.draw(7, F.col("id")))).first()[0] for n in (1, 3, 8)}
    assert len(sums) == 1


def test_empty_two_by_two(spark):
    empty = spark.createDataFrame([], "recording long, k long, n long")
    assert gs.dispersion(empty).first()["ratio"] is None


def test_contract_refuses_other_types(spark):
    with pytest.raises(ValueError):
        a.check_contract(spark.range(1), "frames")


def test_suppression_decides_long_chains(spark):
    """A thousand rising peaks within each other's gap, of which every third from the top stays, and two lone ones."""
    from seamline.operators import segments

    rows = [(1, t, float(t)) for t in range(0, 2000, 2)] + [(1, 5000, 1.0), (2, 7, 3.0)]
    got = {(r.recording, r.t) for r in segments.suppress(spark.createDataFrame(rows, "recording long, t long, d double"), 5).collect()}
    assert got == {(1, t) for t in range(1998, -1, -6)} | {(1, 5000), (2, 7)}
    assert segments.suppress(spark.createDataFrame([], "recording long, t long, d double"), 5).count() == 0


def test_components_of_a_long_chain(spark):
    from seamline.operators import neighbours

    got = neighbours.components(spark.createDataFrame([(i, i + 1) for i in range(700)], "a long, b long")).collect()
    assert len(got) == 701 and {r.component for r in got} == {0}


def test_quantiles_equal_numpy(spark):
    import numpy as np

    from seamline.operators import groupstats

    rng = np.random.default_rng(5)
    for x in (rng.integers(0, 9, 500).astype(float), rng.standard_normal(777), np.array([2.0])):
        probs = [0, 0.001, 0.25, 0.5, 0.9, 1]
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(6)
        assert np.allclose(groupstats.quantiles(df, "x", probs), np.quantile(x, probs))
    assert groupstats.quantiles(df.limit(0), "x", [0.5]) == []


def test_nearest_neighbours_equal_all_pairs(spark):
    import numpy as np

    from seamline.operators import search

    rng = np.random.default_rng(2)
    vec = rng.integers(0, 3, (90, 4)).astype(float)  # many ties
    rows = [(i, i % 7, vec[i].tolist()) for i in range(90)]
    got = sorted((r.query, r.rank, r.neighbour) for r in search.knn(spark.createDataFrame(rows, "unit long, animal int, vec array<double>"), 4).collect())
    want = []
    for i in range(90):
        d = np.sqrt(((vec - vec[i]) ** 2).sum(axis=1))
        order = sorted((j for j in range(90) if j % 7 != i % 7), key=lambda j: (d[j], j))
        want += [(i, k + 1, j) for k, j in enumerate(order[:4])]
    assert got == sorted(want)


def test_growing_sides_are_not_hinted(spark):
    from seamline import catalogue

    for name in ("edgeness", "violations_mask", "local_maxima"):
        df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
        assert "ResolvedHint" not in df._jdf.queryExecution().analyzed().toString()


def test_frames_of_windows_and_allocation():
    from seamline.plans import q_tables

    assert [q_tables.window_frames(s) for s in (0, 0.1, 0.2, 1)] == [1, 3, 7, 31]
    assert q_tables.guard_frames() == 3 and q_tables.least_frames(3) == 12
    assert q_tables.allocate(64, 5) == [13, 13, 13, 13, 12]
