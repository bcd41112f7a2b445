"""The ladder: durations and parameters are charged, terms stay apart, animals share the codebook by time."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seamline.operators import ladder as l
from seamline.operators import ordered as o
from seamline.operators.eventhistory import OPEN_END

EDGES = [0, 1, 2, 4, 8, OPEN_END]


@pytest.fixture(scope="module")
def prepared(spark):
    pick, rows = np.random.default_rng(3), []
    for rec in range(6):
        code = int(pick.integers(4))
        for run in range(60):
            code = int((code + pick.integers(1, 4)) % 4)
            rows.append((rec, f"a{rec % 3}", run, code if pick.random() > 0.1 else -1, int(pick.geometric(0.25))))
    df = spark.createDataFrame(rows, "recording long, animal string, run_id long, code int, duration long")
    return o.prepare(df, "conditioned").withColumn("again", F.col("code") == F.col("next_state")).where("not again or again is null").drop("again")


def total(scored, **where):
    for c, v in where.items():
        scored = scored.where(F.col(c) == v)
    return scored.agg(F.sum("nats")).first()[0]


def test_every_rung_charges_durations(prepared):
    short, _ = l.score(prepared, prepared, EDGES, 4)
    long, _ = l.score(prepared, prepared.withColumn("duration", F.col("duration") * 3), EDGES, 4)
    for rung, k in ((0, 0), (1, 0), (2, 0), (2, 2)):
        assert total(short, rung=rung, k=k) != pytest.approx(total(long, rung=rung, k=k))


def test_a_censored_run_pays_for_its_duration_alone(prepared):
    pmf = {r.bin: r.duration_nats for r in l.pooled_durations(prepared, EDGES).collect()}
    rows = l.table_nats(prepared, prepared, EDGES, 4).withColumn("bin", l.elapsed(EDGES)).collect()
    assert any(r.censored for r in rows)
    for r in rows:
        if r.censored:
            assert r.rung0 == pytest.approx(pmf[r.bin]) == pytest.approx(r.rung1)
        else:
            assert min(r.rung0, r.rung1) > pmf[r.bin]


def test_durations_are_a_distribution_over_whole_frames(prepared):
    pmf = {r.bin: r.duration_nats for r in l.pooled_durations(prepared, EDGES).collect()}
    longest = prepared.agg(F.max("duration")).first()[0]
    share = sum(math.exp(-pmf[sum(d - 1 >= e for e in EDGES[1:-1])]) for d in range(1, longest + 1))
    assert share == pytest.approx(1.0, abs=1e-9)


def test_a_hazard_cell_is_a_distribution(prepared):
    """Staying, the exits seen and the weight of those not seen add up to one in every cell."""
    counts = l.hazard_counts(l.with_contexts(prepared, EDGES, (1,)), EDGES)
    for r in l.cells(counts).collect():
        whole = r.at_risk + 4
        assert ((r.at_risk - r.left) + 1 + r.left + 3) / whole == pytest.approx(1.0)


def test_hazard_equals_a_loop_over_frames(prepared):
    rows = sorted(prepared.collect(), key=lambda r: (r.recording, r.run_id))
    for k in (0, 1, 2):
        risk, exits, context = {}, {}, {}
        past = {}
        for r in rows:
            own = past.setdefault(r.recording, [])
            context[r.recording, r.run_id] = (r.code, *[own[-i] if len(own) >= i else "-" for i in range(1, k + 1)])
            own.append((r.code, sum(r.duration - 1 >= e for e in EDGES[1:-1])))
            for f in range(r.duration - 1 + (not r.censored)):
                cell = context[r.recording, r.run_id], sum(f >= e for e in EDGES[1:-1])
                risk[cell] = risk.get(cell, 0) + 1
                if f == r.duration - 1:
                    exits[cell, r.next_state] = exits.get((cell, r.next_state), 0) + 1
        left = {}
        for (cell, _), n in exits.items():
            left[cell] = left.get(cell, 0) + n
        want = 0.0
        for r in rows:
            for f in range(r.duration - 1 + (not r.censored)):
                cell = context[r.recording, r.run_id], sum(f >= e for e in EDGES[1:-1])
                n = exits.get((cell, r.next_state), 0) if f == r.duration - 1 else risk[cell] - left.get(cell, 0)
                want -= math.log((n + 1) / (risk[cell] + 4))
        got, params = l.score(prepared, prepared, EDGES, 4, (k,))
        assert total(got, rung=2) == pytest.approx(want)
        assert {r.rung: r.n_params for r in params.collect()} == {0: 3 + 4, 1: 8 + 4, 2: len(risk) * 3}


def test_unseen_contexts_and_covariates(prepared):
    fit, out = prepared.where("recording < 5"), prepared.where("recording = 5").withColumn("day", F.lit(9))
    _, plain = l.score(fit, out, EDGES, 4)
    got, params = l.score(fit.withColumn("day", F.col("recording")), out, EDGES, 4, (0,), covariates=("day",))
    rows = out.collect()
    # Nothing was fitted on day 9: every frame costs the logarithm of the number of states.
    assert total(got, rung=2) == pytest.approx(sum(r.duration - r.censored for r in rows) * math.log(4))
    assert params.where("rung = 2").first().n_params > plain.where("rung = 2 and k = 0").first().n_params


def test_a_self_repeat_is_refused(prepared, spark):
    bad = prepared.limit(1).withColumns({"next_state": F.col("code"), "censored": F.lit(False)})
    with pytest.raises(PySparkException, match="own state"):
        l.table_nats(prepared, bad, EDGES, 4).collect()


def test_terms_are_reported_apart_and_the_animal_mean_is_the_pooled_figure(spark):
    rows = [(1, 0, a, 30, v) for a, v in zip("aabb", (1.0, 3.0, 2.0, 4.0), strict=True)]
    scored = spark.createDataFrame(rows, "rung int, k int, animal string, duration long, nats double")
    params, n = spark.createDataFrame([(1, 0, 4)], "rung int, k int, n_params long"), spark.createDataFrame([(100,)], "n_fit long")
    r = l.code_length(scored, params, n, 30.0).first()
    assert r.data_nats == 10 and r.codebook_nats == pytest.approx(4 * 0.5 * math.log(100)) and r.total_nats == pytest.approx(r.data_nats + r.codebook_nats)
    assert r.t_seconds == 4 and r.data_nats_per_second == pytest.approx(2.5) and r.nats_per_run == pytest.approx(2.5)
    own = l.per_animal(scored, params, n, 30.0).collect()
    assert np.mean([x.nats_per_second for x in own]) == pytest.approx(r.nats_per_second)
    assert {x.animal: round(x.nats_per_second - r.codebook_nats / 4, 9) for x in own} == {"a": 2.0, "b": 3.0}
