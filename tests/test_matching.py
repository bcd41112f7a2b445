"""Matching without replacement against a plain deferred acceptance, and the promises of trial plans."""

import random
import statistics
from collections import Counter

import numpy as np
import pytest

from seamline.operators import matching as mt


def segs(spark, rows):
    return spark.createDataFrame(rows, "unit long, animal long, n_frames long, speed double")


def islands(k=40):  # slow and long
    return [(i, i % 13, 40 + i, 0.08 + 0.001 * i) for i in range(k)]


def pool(k=400):
    return [(1000 + i, 100 + i % 47, 10 + i % 200, 0.05 + 0.01 * (i % 40)) for i in range(k)]


def plain(targets, controls):
    """Targets ask down their whole lists, controls keep the nearest; distance, then unit, decides everything."""
    f = lambda r: np.log([max(r[2], 1), max(r[3], 1e-9)])
    d = {(t[0], c[0]): float(np.sqrt(((f(t) - f(c)) ** 2).sum())) for t in targets for c in controls if t[1] != c[1]}
    lists = {t[0]: sorted((d[k], k[1]) for k in d if k[0] == t[0]) for t in targets}
    held, free = {}, [t[0] for t in targets]
    while free:
        t = free.pop()
        if not lists[t]:
            continue
        cost, c = lists[t].pop(0)
        if c in held and held[c] < (cost, t):
            free.append(t)
        else:
            if c in held:
                free.append(held[c][1])
            held[c] = cost, t
    return {t: c for c, (_, t) in held.items()}


@pytest.mark.parametrize("start", [2, 16])
def test_same_as_deferred_acceptance_by_hand(spark, monkeypatch, start):
    monkeypatch.setattr(mt, "START", start)
    pick = random.Random(3)
    t = [(i, pick.randrange(4), pick.randint(16, 40), 0.1 + pick.random() / 5) for i in range(60)]
    c = [(500 + i, pick.randrange(4), pick.randint(16, 40), 0.1 + pick.random() / 5) for i in range(70)]
    got = {r.target: r.control for r in mt.match_controls(segs(spark, t), segs(spark, c), n_near=1).collect()}
    assert got == plain(t, c) and len(set(got.values())) == len(got) == 60


def test_more_targets_than_controls_and_forbidden_animals(spark):
    t, c = [(i, 0, 40 + i, 0.08) for i in range(5)], [(10, 0, 40, 0.08), (11, 1, 400, 2.0), (12, 2, 41, 0.081)]
    got = {r.target: r.control for r in mt.match_controls(segs(spark, t), segs(spark, c), n_near=1).collect()}
    assert got == plain(t, c) and set(got.values()) == {11, 12} and got[1] == 12
    assert mt.match_controls(segs(spark, t), segs(spark, c[:1])).collect() == []


def test_a_drawn_order_stays_among_the_nearest(spark):
    got = mt.match_controls(segs(spark, islands(3)), segs(spark, pool()), n_near=5, seed=1).collect()
    again = mt.match_controls(segs(spark, islands(3)), segs(spark, pool()).repartition(5), n_near=5, seed=1).collect()
    assert sorted(got) == sorted(again) and len(got) == 3
    first = plain(islands(3), pool())
    assert any(r.control != first[r.target] for s in range(3) for r in mt.match_controls(segs(spark, islands(3)), segs(spark, pool()), 5, s).collect())


@pytest.fixture(scope="module")
def plans(spark):
    return {arm: mt.plan_trials(segs(spark, islands(60)), segs(spark, pool()), arm, 36, 4).collect() for arm in ("matched", "unmatched")}


def test_trials_show_three_animals_and_no_clip_twice(plans):
    for rows in plans.values():
        assert len(rows) == 36
        assert all(len(set(r.animals)) == 3 and len(r.clips) == 3 for r in rows)
        assert max(Counter(c for r in rows for c in r.clips).values()) == 1


def test_positions_are_balanced_and_hold_the_odd_clip(plans):
    for rows in plans.values():
        n = Counter(r.odd_position for r in rows)
        assert max(n.values()) - min(n[i] for i in range(3)) <= 1
        for r in rows:
            kinds = [c >= 1000 for c in r.clips]
            odd = kinds.pop(r.odd_position)
            assert kinds == [not odd] * 2 and (r.odd_is == "control") == odd
        assert Counter(r.type for r in rows) == {"island_pair": 18, "control_pair": 18}
        assert all(r.odd_is == {"island_pair": "control", "control_pair": "island"}[r.type] for r in rows)


def test_the_matched_arm_is_closer_in_speed(plans):
    speed = {u: s for u, _, _, s in islands(60) + pool()}
    gap = {arm: statistics.median(max(speed[c] for c in r.clips) / min(speed[c] for c in r.clips) for r in rows) for arm, rows in plans.items()}
    assert gap["matched"] < gap["unmatched"]


def test_ids_name_arm_type_and_number_only(spark, plans):
    ids = [r.id for rows in plans.values() for r in rows]
    assert len(set(ids)) == 72 and all(i.startswith("t") and len(i) == 11 for i in ids)
    other = mt.plan_trials(segs(spark, islands(60)), segs(spark, pool()), "matched", 36, 99).collect()
    assert {r.id for r in other} == {r.id for r in plans["matched"]}


def test_too_few_islands_and_an_unknown_arm(spark):
    assert mt.plan_trials(segs(spark, islands(2)), segs(spark, pool()), "matched", 12).collect() == []
    with pytest.raises(ValueError, match="unknown arm"):
        mt.plan_trials(segs(spark, islands(2)), segs(spark, pool()), "other", 12)
