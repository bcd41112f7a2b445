"""Streaming queries, each equal to its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.plans.q_ordered import RUNS_SQL
from seamline.streaming import events as st


def _source(spark, sf_dir):
    return st.source(spark, f"{sf_dir}/events.parque[t]")


def stream_window_counts(spark, sf_dir):
    out = st.drain(st.window_counts(_source(spark, sf_dir)), "complete", final=True)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_rle(spark, sf_dir):
    return st.drain(st.runs(_source(spark, sf_dir)), "append").select("recording", "run_id", "code", "start_t", "duration")


QUERIES = {f.__name__: f for f in (stream_window_counts, stream_rle)}
ORACLE = {
    "stream_window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_rle": f"WITH {RUNS_SQL} SELECT recording, run_id, code, start_t, duration FROM runs QUALIFY lead(run_id) OVER (PARTITION BY recording ORDER BY run_id) IS NOT NULL",
}
