"""Streaming forms of run-length encoding and window counts; an extension, checked against the batch results.

Sources are files, sinks are Parquet in the shared folder, triggers take all that is there. State is one small tuple per
recording; rows of a recording must arrive in order of time, batch by batch (within a batch they are sorted).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seamline.operators.segments import shared_folder

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def shared(spark: SparkSession) -> str:
    """A new folder below the one that the session shares."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str) -> DataFrame:
    """Files at a path or glob as a stream; event time becomes a timestamp with zone, as watermarks ask for."""
    return spark.readStream.schema(SCHEMA).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(df: DataFrame, mode: str, final: bool = False) -> DataFrame:
    """Run a stream over all its present input and return what it wrote; ``final`` keeps the last batch only."""
    spark, home = df.sparkSession, shared(df.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/out" if final else f"{home}/out/batch={number}")

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{home}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(df.schema).parquet(f"{home}/out")


def window_counts(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and mean value per tumbling window and type; rows later than ``late`` after the newest are dropped."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def runs(events: DataFrame) -> DataFrame:
    """Closed runs of each recording as they end: recording, run_id, code, start_t, duration. The open run stays in state."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        run, code, start, t = state.get if state.exists else (0, None, 0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for c in rows["code"].tolist():
            if c != code:
                if code is not None:
                    out.append((key[0], run, code, start, t - start))
                run, code, start = run + 1, c, t
            t += 1
        state.update((run, code, start, t))
        yield pd.DataFrame(out, columns=["recording", "run_id", "code", "start_t", "duration"])

    code = F.expr("CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE -1 END")
    keyed = events.select(F.col("user_id").alias("recording"), "ts", "event_id", code.alias("code"))
    return keyed.groupBy("recording").applyInPandasWithState(
        step, "recording long, run_id long, code int, start_t long, duration long", "run long, code int, start long, t long", "append", GroupStateTimeout.NoTimeout
    )
