"""Chance agreement drawn and matched inside tasks equals a plain version, and keeps nothing on disk."""

from hashlib import md5
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seamline.operators import annotation as an
from seamline.operators.segments import durable
from seamline.plans import q_intervals as qi


def plain_draw(seed, who, clip, rep, k, n):
    frames = []
    for i in range(k):
        u = int(md5(f"{seed}|{who}|{clip}|{rep}|{i}".encode()).hexdigest()[:8], 16) / 2.0**32
        t = int(u * (n - k + i + 1))
        frames.append(n - k + i if t in frames else t)
    return frames


def plain_f1(a, b, tol):
    pairs, ua, ub = sorted((abs(x - y), x, y) for x in a for y in b if abs(x - y) <= tol), set(), set()
    for _, x, y in pairs:
        if x not in ua and y not in ub:
            ua.add(x), ub.add(y)
    return 2 * len(ua) / (len(a) + len(b))


CLIPS = [(0, 8, 8, 60), (1, 30, 12, 40), (2, 9, 3, 4), (3, 1, 1, 1), (4, 5, 0, 9), (5, 3, 4, 0)]


@pytest.mark.parametrize("draws", [1, 1 << 18])
def test_replicates_equal_a_plain_loop(spark, monkeypatch, draws):
    monkeypatch.setattr(an, "DRAWS", draws)
    clips = spark.createDataFrame(CLIPS, "clip long, n_a long, n_b long, n_frames long")
    got = {r.clip: r.chance_f1 for r in an.chance_f1(clips, 3, 21, 5).collect()}
    for clip, na, nb, n in CLIPS[:4]:
        one = [plain_f1(*(plain_draw(5, w, clip, rep, min(k, n), n) for w, k in (("n_a", na), ("n_b", nb))), 3) for rep in range(21)]
        assert got[clip] == pytest.approx(sum(one) / 21, abs=1e-12)
    assert got[4] == got[5] == 0.0
    marks = sorted(tuple(r) for r in an.scattered(clips, "n_a", "who", 3, 5).where("clip = 1").collect())
    assert marks == sorted((1, rep, f) for rep in range(3) for f in plain_draw(5, "who", 1, rep, 30, 40))


def test_scattered_marks_are_not_kept(spark):
    clips = spark.createDataFrame([(c, 200, 200, 4000) for c in range(10)], "clip long, n_a long, n_b long, n_frames long")
    kept = lambda: sum(f.stat().st_size for f in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("*") if f.is_file())
    durable(clips)  # the folder is named
    before = kept()
    assert an.chance_f1(clips, 6, 50).count() == 10
    assert kept() - before < 100_000  # 200,000 marks, 16 bytes each at least, were written


def test_ties_are_rounded_as_in_sql(spark):
    assert spark.range(1).select(qi.R(F.lit(0.2534375)).alias("x")).first().x == 0.253437
