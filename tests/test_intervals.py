"""Fits by prefix sums, windows by inverse sampling, planted runs, chance agreement, cheapest paths in blocks."""

import random
from collections import Counter

import numpy as np
import pytest

from seamline.operators import annotation as an
from seamline.operators import intervals as iv
from seamline.operators import viterbi as vt


def fit(y):
    """Cubic fit on the samples themselves."""
    v = np.vander(np.linspace(-1, 1, len(y)), 4, increasing=True)
    rest = y - v @ np.linalg.lstsq(v, y, rcond=None)[0]
    r2 = 1 - (rest**2).sum() / ((y - y.mean()) ** 2).sum()
    return r2, 1 - (1 - r2) * (len(y) - 1) / (len(y) - 4)


def test_any_interval_is_a_difference_of_two_rows(spark):
    pick = np.random.default_rng(0)
    x = np.round(np.cumsum(pick.normal(size=3000)) + 500, 6)
    frames = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "recording long, t long, x double")
    spans = [(s, s + n) for s, n in zip(pick.integers(0, 2000, 60).tolist(), pick.integers(5, 900, 60).tolist(), strict=True)] + [(0, 3000), (2995, 3000), (10, 14)]
    got = iv.interval_fit(iv.prefix_moments(frames, "x"), spark.createDataFrame([(1, *s) for s in spans], "recording long, start long, stop long")).collect()
    assert len(got) == len(spans)
    for r in got:
        if r.n < 5:
            assert r.r2 is None
        else:
            assert (r.r2, r.r2_adj) == pytest.approx(fit(x[r.start : r.stop]), abs=1e-7)


def test_smooth_segments_win_and_length_is_held(spark):
    pick = np.random.default_rng(1)
    x, segments = pick.normal(size=400), []
    for s in (40, 150, 300):
        x[s : s + 30] = np.linspace(-2, 2, 30) ** 3 + pick.normal(size=30) * 0.05
        segments.append((7, s, s + 30))
    frames = spark.createDataFrame([(7, i, float(v)) for i, v in enumerate(x)], "recording long, t long, x double")
    r = iv.length_matched_control(frames, spark.createDataFrame(segments, "recording long, start long, stop long"), "x", 20, 3).first()
    assert r.n_compared == 60 and r.win_rate > 0.95 and r.mean_delta > 0.3
    whole = spark.createDataFrame([(7, 0, 400)], "recording long, start long, stop long")
    assert iv.length_matched_control(frames, whole, "x", 5).collect() == []  # no other interval of its length


def test_windows_match_lengths_and_stay_inside_islands(spark):
    islands = [(1, 0, 2000), (1, 2400, 3000), (2, 0, 3000), (3, 5, 12)]
    durations = [10, 40, 40, 90, 200, 5000]
    got = iv.matched_windows(spark.createDataFrame(islands, "recording long, start long, stop long"), spark.createDataFrame([(d,) for d in durations], "n_frames long"), 2000, 1).collect()
    n = Counter(w.n_frames for w in got)
    assert set(n) == {10, 40, 90, 200} and 300 < len(got) - n[40] < 1150 and abs(n[40] - 2 * n[90]) < 200
    for w in got:
        assert w.stop - w.start == w.n_frames and any(r == w.recording and a <= w.start and w.stop <= b for r, a, b in islands)
    ten = [w for w in got if w.n_frames == 200]  # each feasible start as likely
    share = sum(w.recording == 2 for w in ten) / len(ten)
    assert abs(share - 2801 / (1801 + 401 + 2801)) < 0.1


def test_an_island_of_the_very_length_has_one_start(spark):
    islands = spark.createDataFrame([(1, 7, 17), (1, 30, 39)], "recording long, start long, stop long")
    got = iv.matched_windows(islands, spark.createDataFrame([(10,)], "n_frames long"), 20).collect()
    assert {(w.start, w.stop) for w in got} == {(7, 17)} and len(got) == 20
    assert iv.matched_windows(islands, spark.createDataFrame([(11,)], "n_frames long"), 20).collect() == []
    assert iv.matched_windows(islands.limit(0), spark.createDataFrame([(3,)], "n_frames long"), 5).collect() == []
    assert iv.matched_windows(islands, spark.createDataFrame([], "n_frames long"), 5).collect() == []


def test_every_planted_run_falls_in_one_class(spark):
    pick = random.Random(6)
    planted, peaks, rows = set(), set(), set()
    for rec in range(5):
        for s in range(0, 400, 20):
            planted.add((rec, s, s + pick.randint(6, 14)))
        cuts = sorted(pick.sample(range(400), 60))
        peaks |= {(rec, t) for t in cuts}
        rows |= {(rec, a, b) for a, b in zip(cuts, cuts[1:], strict=False) if pick.random() < 0.8}

    def by_hand(r, s, e, tol):
        near = lambda x: any(q == r and abs(t - x) <= tol for q, t in peaks)
        if any(q == r and abs(a - s) <= tol and abs(b - e) <= tol for q, a, b in rows):
            return "isolated"
        if not near(s) and not near(e):
            return "no_edge"
        if near(s) != near(e):
            return "one_edge"
        return "split" if any(q == r and s + tol < t < e - tol for q, t in peaks) else "merged"

    df = lambda x, c: spark.createDataFrame(sorted(x), c)
    for tol in (0, 2):
        got = iv.classify(df(planted, "recording long, start long, stop long"), df(peaks, "recording long, t long"), df(rows, "recording long, start long, stop long"), tol).collect()
        assert {(r.recording, r.start, r.stop): r.found for r in got} == {p: by_hand(*p, tol) for p in planted} and len(got) == len(planted)


def test_chance_rises_with_tolerance_and_is_small_for_sparse_marks(spark):
    clips = spark.createDataFrame([(0, 8, 8, 300), (1, 3, 3, 3000), (2, 0, 0, 300), (3, 0, 4, 300), (4, 9, 9, 4)], "clip long, n_a long, n_b long, n_frames long")
    low, high = ({r.clip: r.chance_f1 for r in an.chance_f1(clips, tol, 60, 2).collect()} for tol in (2, 10))
    assert high[0] > low[0] > 0 and low[1] < 0.1
    assert low[2] == 1.0 and low[3] == 0.0 and low[4] == pytest.approx(4 * 2 / 18 * 18 / 8)  # four frames hold four marks, all met
    marks = an.scattered(clips, "n_a", "a", 30, 1).collect()
    assert Counter(Counter((r.clip, r.rep) for r in marks).values()) == {8: 30, 3: 30, 4: 30} and len({tuple(r) for r in marks}) == len(marks)


def loop(x, n_back=3, step=30.0, miss=8.0):
    """The whole recording at once."""
    cand = np.array([[x[max(t - b, 0)] for b in range(n_back + 1)] for t in range(len(x))])
    price = np.array([0.0] + [miss] * n_back)
    cost, back = price.copy(), []
    for t in range(1, len(x)):
        move = ((cand[t][:, None] - cand[t - 1][None, :]) / step) ** 2 + cost[None, :]
        back.append(move.argmin(1))
        cost = move.min(1) + price
    path = [int(cost.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return [float(cand[t][s]) for t, s in enumerate(reversed(path))], [s > 0 for s in reversed(path)]


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_paths_in_blocks_equal_one_loop(spark, block):
    pick = np.random.default_rng(4)
    signals = {r: np.round(np.cumsum(pick.normal(size=n)) * 20 + (pick.random(n) < 0.08) * 400, 3) for r, n in ((1, 200), (2, 1), (3, 3), (4, 61))}
    frames = spark.createDataFrame([(r, t, float(v)) for r, x in signals.items() for t, v in enumerate(x)], "recording long, t long, x double")
    got = {}
    for r in sorted(vt.viterbi(frames, block=block).collect()):
        got.setdefault(r.recording, []).append((r.y, r.replaced))
    for r, x in signals.items():
        y, replaced = loop(x.tolist())
        assert got[r] == list(zip(y, replaced, strict=True))
    assert any(z for _, z in got[1])
