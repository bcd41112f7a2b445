"""Paths that cost the same: the one that costs added frame after frame find, as in SQL."""

import pytest

from seamline.operators import viterbi as vt

SIGNALS = {
    1: [140.34, 147.11, 50.55, 17.03, 125.96, 150.47, 54.11, 13.2, 8.2, 73.88, 43.4, 49.11, 39.96, 8.54, 63.07, 7.61, 1.88, 21.04, 40.44, 36.23, 20.45, 10.14, 10.29, 133.7, 58.86, 3.59, 2.06, 103.3, 104.58, 16.52, 50.88, 367.07, 58.87, 16.3, 23.97, 36.72, 37.68, 105.9, 45.51, 16.18, 0.16, 203.45, 97.18, 36.06, 78.38, 45.29, 19.27, 22.81, 2.39, 75.87, 61.79, 25.36, 24.58, 88.85, 6.95, 1.66, 11.91, 3.41, 98.54, 48.25, 25.82, 11.45, 46.31, 43.34, 115.91, 8.88, 34.92],
    2: [12.49, 6.78, 0.56, 4.46, 12.19, 40.76, 36.95, 130.61, 205.21, 39.41, 32.98, 185.9, 7.95, 15.66, 95.14, 42.95, 96.49, 132.43, 3.85, 34.41, 45.58, 14.56, 178.51, 65.97, 1.12, 54.87, 22.43, 90.32, 33.07, 83.55, 24.7, 24.84, 189.5, 48.57, 40.84, 0.42, 41.22, 20.33, 106.05, 76.45, 144.45, 11.07, 2.02, 49.17, 7.66, 9.31, 40.6, 34.92, 23.1, 52.74, 89.67, 77.75, 41.35, 21.76, 38.26, 5.2, 71.19, 36.78, 175.82, 3.9, 2.06, 26.9, 26.21, 96.37, 142.46, 40.73, 5.6, 25.69, 77.34, 38.37],
    3: [5.0],
}


def loop(x, step=30.0, miss=8.0):
    cand = [[x[max(t - b, 0)] for b in range(4)] for t in range(len(x))]
    cost, back = [0.0, miss, miss, miss], []
    for t in range(1, len(x)):
        moves = [[((v - u) / step) * ((v - u) / step) + c for u, c in zip(cand[t - 1], cost, strict=True)] for v in cand[t]]
        back.append([m.index(min(m)) for m in moves])
        cost = [min(m) + (miss if b else 0.0) for b, m in enumerate(moves)]
    path = [cost.index(min(cost))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return [(cand[t][s], s > 0) for t, s in enumerate(reversed(path))]


@pytest.mark.parametrize("block", [1, 32, 10_000])
def test_of_paths_that_cost_the_same_the_one_of_the_loop(spark, block):
    rows = [(r, t, v) for r, x in SIGNALS.items() for t, v in enumerate(x)]
    got = {}
    for r in sorted(vt.viterbi(spark.createDataFrame(rows, "recording long, t long, x double"), block=block).collect()):
        got.setdefault(r.recording, []).append((r.y, r.replaced))
    assert got == {r: loop(x) for r, x in SIGNALS.items()}


def test_names_for_recordings_and_frames_without_a_value(spark):
    rows = [("b", 0, 1.0), ("b", 1, 400.0), ("b", 2, 2.0), ("a", 5, None), ("a", 6, 3.0)]
    got = sorted(vt.viterbi(spark.createDataFrame(rows, "recording string, t int, x double")).select("recording", "t").collect())
    assert [tuple(r) for r in got] == sorted((r, t) for r, t, _ in rows)
