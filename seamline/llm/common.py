"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words of every word-based operator.
SPACE = "\\x20\\x09-\\x0D"
#: A null identifier orders before every other one.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session (a test) may name none, and gets a temporary folder of its own.
    """
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="seamline-"))
    return named or sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps whose tables stand.

    They go when the driver's collector finds the plans that named them, which a small driver heap may never call for by itself.
    """
    gc.collect()
    spark._jvm.System.gc()


def flat(text):
    """The text with every white space character as a blank; null is the empty string."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":  # five byte searches, far cheaper than one translate()
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words_of(text):
    """Non-empty words of a text column, split at ASCII white space; null gives none."""
    return F.filter(F.split(flat(text), " ", -1), lambda w: w != "")


def aside(df: DataFrame, *own: str):
    """``df`` with all columns but ``own`` under names that no operator uses, and a function from original names to them.

    What an operator adds on its way can then clash with no column of the input.
    """
    names = {c: f"user_{k}" for k, c in enumerate(df.columns) if c not in own}
    here = lambda c: F.col(f"`{c}`")
    return df.select(*[here(c).alias(names.get(c, c)) for c in df.columns]), lambda columns: [here(names.get(c, c)).alias(c) for c in columns]


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return freed memory to the system: Python workers stay for later tasks and stages, and would keep what one once took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there is none outside glibc
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, fn, schema: str, rows: int = 1024) -> DataFrame:
    """``mapInArrow`` over batches of ``rows`` rows at most, so that what a batch is turned into stays small.

    Spark bounds the bytes of the batches it sends; they are cut here, so no setting of the session is touched. What the task
    has freed goes back when it ends.
    """

    def cut(batches):
        yield from fn(b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))
        give_back()

    return df.mapInArrow(cut, schema)
