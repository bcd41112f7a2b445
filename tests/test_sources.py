"""Manifests, frozen reports, verdicts, models, streaming state."""

import pytest
from pyspark.sql import functions as F

from seamline.functions import verdict as v
from seamline.operators import models as m
from seamline.sources import manifest as mf


def test_manifest_drift_and_freeze(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    (data / "a.txt").write_text("one")
    (data / "b.txt").write_text("two")
    before = mf.manifest(spark, str(data))
    mf.freeze(before, str(tmp_path / "m"))
    with pytest.raises(Exception, match="(?i)exist"):
        mf.freeze(before, str(tmp_path / "m"))
    old = mf.frozen(spark, str(tmp_path / "m"), "name string, length long, sha256 string")
    assert mf.drift(before, old).count() == 0
    first = mf.digest(before).first()
    (data / "b.txt").write_text("2")
    (data / "c.txt").write_text("three")
    now = mf.manifest(spark, str(data))
    assert {(r.name, r.change) for r in mf.drift(now, old).collect()} == {("b.txt", "changed"), ("c.txt", "added")}
    assert first.files == 2 and mf.digest(now).first().digest != first.digest
    with pytest.raises(KeyError):
        mf.path_in({"x": "/d"}, "y", "z")


@pytest.mark.parametrize(("lo", "hi", "n", "want"), [(0.1, 0.2, 5, "PASS"), (-0.2, -0.1, 5, "FAIL"), (-0.1, 0.1, 5, "INCONCLUSIVE"), (0.1, 0.2, 1, "NOT_A_RESULT"), (None, None, 5, "INCONCLUSIVE")])
def test_ladder_verdicts(spark, lo, hi, n, want):
    df = spark.createDataFrame([(lo, hi, n)], "lo double, hi double, n long")
    assert v.read("ladder", df, v.RULES["ladder"], "n", 2).first().verdict == want
    with pytest.raises(ValueError):
        v.read("x", df, [("true", "MAYBE", "")], "n")


def series(spark, n=240):
    import math

    rows = [(r, t, math.sin(t / 5) * 3 + (t * 7919 + r * 31) % 11 / 5) for r in (0, 1) for t in range(n)]
    return spark.createDataFrame(rows, "recording long, t long, x double")


def test_phase_surrogate_keeps_the_spectrum(spark):
    import numpy as np

    f = series(spark)
    y = m.surrogate(f, "phase").where("recording = 0").orderBy("t").toPandas()["y"].to_numpy()
    x = f.where("recording = 0").orderBy("t").toPandas()["x"].to_numpy()
    assert np.allclose(np.abs(np.fft.rfft(x)), np.abs(np.fft.rfft(y)))
    again = m.surrogate(f.repartition(5), "phase").where("recording = 0").orderBy("t").toPandas()["y"].to_numpy()
    assert np.allclose(y, again)
    with pytest.raises(ValueError):
        m.surrogate(f, "none")


def test_viterbi_removes_a_teleport(spark):
    rows = [(0, t, 500.0 if t == 20 else float(t)) for t in range(40)]
    out = m.viterbi(spark.createDataFrame(rows, "recording long, t long, x double")).where("t = 20").first()
    assert out.replaced and abs(out.y - 20) < 5


def test_two_groups_have_a_gain(spark):
    one = spark.range(2000).select(((F.col("id") * 7919) % 1000 / 1000).alias("x"))
    two = one.union(one.select(F.col("x") + 50))
    assert m.mixture_bic_gain(two, "x").first().bic_gain > 100
    assert m.mixture_bic_gain(one.limit(0), "x").count() == 0


def test_stream_state_carries_over_batches(spark, tmp_path):
    from seamline.streaming import events as st

    base = "timestamp_ntz'2024-01-01 00:00:00'"
    for i, kinds in enumerate((["click", "click", "view"], ["view", "click"])):
        rows = [(i * 10 + j, 1, k, i * 10 + j) for j, k in enumerate(kinds)]
        df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s int")
        df = df.select("event_id", F.expr(f"{base} + make_interval(0, 0, 0, 0, 0, 0, s)").alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(st.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted(tuple(r) for r in st.drain(st.runs(events), "append").select("code", "start_t", "duration").collect())
    assert got == [(0, 0, 2), (3, 2, 2)]
