"""Places within groups, and near against far runs by draws of counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seamline.operators import permutation as pm
from seamline.operators import ranking as rk


@pytest.mark.parametrize("group", [[], ["g"]])
def test_places_equal_a_sorted_list(spark, group):
    pick = random.Random(1)
    rows = [(i, pick.choice(["a", "a", "a", "b", None]), pick.choice([0.5, 1.0, None, 2.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r.id: (r.place, r.n) for r in rk.placed(df, ["v", "id"], group, size="n").collect()}
    n = Counter(g for _, g, _ in rows)
    place = Counter()
    for i, g, _v in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        key = g if group else "all"
        assert got[i] == (place[key], n[g] if group else 500)
        place[key] += 1


def test_quartiles_are_cut_inside_each_group(spark):
    rows = [("a", float(i), i) for i in range(10)] + [("b", 1.0, i) for i in range(3)] + [("a", None, 99)]
    got = rk.quartiles_within(spark.createDataFrame(rows, "g string, v double, id int"), "v", ["g"], ["id"]).collect()
    assert Counter(r.quartile for r in got if r.g == "a") == {0: 2, 1: 3, 2: 2, 3: 3, -1: 1}
    assert {r.quartile for r in got if r.g == "b"} == {-1}


def test_subsets_are_distinct_and_even(spark):
    df = spark.range(3000).select(pm.subset(F.lit(10), 4, pm.uniforms(4, F.lit("s"), F.col("id"))).alias("s"))
    seen = Counter()
    for r in df.collect():
        assert len(set(r.s)) == 4 and all(0 <= x < 10 for x in r.s)
        seen.update(r.s)
    assert all(abs(seen[x] - 1200) < 110 for x in range(10))  # four standard deviations
    whole = spark.range(20).select(pm.subset(F.lit(7), 7, pm.uniforms(7, F.col("id"))).alias("s")).collect()
    assert all(sorted(r.s) == list(range(7)) for r in whole)


def test_counts_by_category(spark):
    df = spark.sql("SELECT array(0L, 1L, 5L, 9L) AS p, array(2L, 0L, 4L, 4L) AS c")
    assert df.select(pm.falling(F.col("p"), F.col("c")).alias("n")).first().n == [2, 0, 1, 1]


def runs(spark, n, states, shift, animals=8):
    """Next states of near and far runs; ``shift`` of the far ones go to one state."""
    pick, rows = random.Random(2), []
    for i in range(n):
        q = i % 4
        nxt = 0 if q == 3 and pick.random() < shift else pick.randrange(states)
        rows.append((0, None if i % 19 == 0 else nxt, pick.randrange(3), q, 1 + i % 3, f"a{i // 4 % animals}"))
    return spark.createDataFrame(rows, "code int, next_state int, duration_bin int, quartile int, duration long, animal string")


def test_the_excess_is_none_under_a_true_null_and_positive_under_a_shift(spark):
    null = {r.what: r for r in pm.symbol_table(runs(spark, 1600, 60, 0.0), n_perm=150, n_fix=80).collect()}
    assert null["next"].tv > 0.4 and abs(null["next"].excess) < 0.05 and null["next"].p > 0.05  # the plain distance is all bias
    assert null["next"].n_near + null["next"].n_far < null["next"].n_runs == 800  # the middle quartiles and censored runs are out
    assert null["duration"].n_near + null["duration"].n_far == 800
    real = {r.what: r for r in pm.symbol_table(runs(spark, 1600, 60, 0.6), n_perm=150, n_fix=80).collect()}
    assert real["next"].excess > 0.15 and real["next"].p == pytest.approx(1 / 151) and abs(real["duration"].excess) < 0.05


def test_small_symbols_and_small_sides(spark):
    assert pm.symbol_table(runs(spark, 300, 5, 0.0), n_perm=5).collect() == []  # 150 runs are under the least
    rows = pm.symbol_table(runs(spark, 500, 5, 0.0), n_perm=5, n_fix=400).collect()
    assert len(rows) == 2 and all(r.tv is None and r.p is None and r.n_runs == 250 for r in rows)


def test_the_interval_leaves_out_animals(spark):
    df = runs(spark, 2400, 20, 0.6)
    table = pm.symbol_table(df, n_perm=100)
    left = pm.leave_one_out(df, table)
    assert left.count() == 8
    ci = pm.interval(left, pm.aggregate(table)).first()
    assert ci.lo < ci.point < ci.hi and ci.lo > 0 and ci.n_groups == 8
    assert pm.interval(left.limit(2), pm.aggregate(table)).first().lo is None


def test_quantiles_by_place(spark):
    pick = random.Random(9)
    rows = [(pick.choice("aab"), None if i % 17 == 0 else round(pick.gauss(0, 1), 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"low": 0.1, "mid": 0.5, "top": 0.999}
    want = df.groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()])
    for group, have in (["g"], want), ([], df.agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()])):
        got = sorted(map(tuple, rk.quantiles_by(df, "v", probs, group).collect()))
        for a, b in zip(got, sorted(map(tuple, have.collect())), strict=True):
            assert a[: len(group)] == b[: len(group)] and a[len(group) :] == pytest.approx(b[len(group) :])
