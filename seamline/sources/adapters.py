"""Views that give the driver's tables the shape of the engine's inputs, and the schema contracts of those shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ABSTAIN = -1
#: Column types each operator family relies on; see ``check_contract``.
CONTRACTS = {
    "frames": {"recording": "bigint", "animal": "bigint", "t": "bigint", "code": "int", "x": "double", "split": "string"},
    "pose": {"recording": "int", "t": "bigint", "pose": "array<struct<x:double,y:double>>", "conf": "array<double>", "missing": "array<boolean>"},
    "bank": {"unit": "bigint", "animal": "int", "vec": "array<double>"},
    "groups": {"recording": "bigint", "animal": "int", "mask": "boolean", "value": "double", "weight": "double"},
    "cells": {"animal": "int", "day": "int", "context": "string", "label": "boolean", "n_frames": "double"},
    "marks": {"clip": "bigint", "rater": "string", "frame": "bigint"},
}


def check_contract(df: DataFrame, name: str) -> DataFrame:
    """Refuse a frame whose columns or types differ from the contract; no data is read."""
    want, have = CONTRACTS[name], dict(df.dtypes)
    wrong = {c: (t, have.get(c)) for c, t in want.items() if have.get(c) != t}
    if wrong:
        raise ValueError(f"{name}: expected and found types differ: {wrong}")
    return df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: one recording per user, code by event type (error abstains), value as signal."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    code = F.expr("CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE -1 END")
    animal = F.col("user_id") % 10
    split = F.when(animal < 2, "tune").when(animal < 7, "fit").otherwise("report")
    df = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording"),
        animal.alias("animal"),
        (F.row_number().over(order) - 1).cast("bigint").alias("t"),
        code.cast("int").alias("code"),
        F.col("value").alias("x"),
        split.alias("split"),
        "ts",
    )
    return check_contract(df, "frames")


FRAMES_SQL = """frames AS (
  SELECT user_id AS recording, user_id % 10 AS animal, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
         CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE -1 END AS code,
         value AS x, CASE WHEN user_id % 10 < 2 THEN 'tune' WHEN user_id % 10 < 7 THEN 'fit' ELSE 'report' END AS split
  FROM events)"""


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: seven keypoints from the first 14 components, confidences and gaps from the next 14."""
    e = F.col("embedding")
    at = lambda k: F.get(e, k).cast("double")
    df = read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("recording"),
        (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("bigint").alias("t"),
        F.array(*[F.struct(at(2 * j).alias("x"), at(2 * j + 1).alias("y")) for j in range(7)]).alias("pose"),
        F.array(*[F.abs(at(14 + j)) for j in range(7)]).alias("conf"),
        F.array(*[F.abs(at(21 + j)) < F.lit(0.01) for j in range(7)]).alias("missing"),
    )
    return check_contract(df, "pose")


def keypoints(pose_df: DataFrame) -> DataFrame:
    """Long form: one row per recording, t and keypoint k."""
    zipped = F.arrays_zip("pose", "conf", "missing")
    long = pose_df.select("recording", "t", F.posexplode(zipped).alias("k", "z"))
    return long.select("recording", "t", "k", F.col("z.pose.x").alias("x"), F.col("z.pose.y").alias("y"), F.col("z.conf").alias("conf"), F.col("z.missing").alias("missing"))


#: ``kp`` is the long form of the pose view.
POSE_SQL = """pose AS (
  SELECT label AS recording, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding AS e FROM embeddings),
kp AS (
  SELECT recording, t, k::INT AS k, e[2*k+1]::DOUBLE AS x, e[2*k+2]::DOUBLE AS y, abs(e[15+k]::DOUBLE) AS conf, abs(e[22+k]::DOUBLE) < 0.01 AS missing
  FROM pose, range(7) r(k))"""


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit"), F.col("label").alias("animal"), F.col("embedding").cast("array<double>").alias("vec"))
    return check_contract(df, "bank")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem by supplier: returned lines as mask, price as value, quantity as weight."""
    lines, suppliers = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    df = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select(
        F.col("l_suppkey").alias("recording"),
        F.col("s_nationkey").alias("animal"),
        (F.col("l_returnflag") == "R").alias("mask"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_quantity").alias("weight"),
        "l_discount",
        "l_tax",
    )
    return check_contract(df, "groups")


GROUPS_SQL = """groups AS (
  SELECT l_suppkey AS recording, s_nationkey AS animal, l_returnflag = 'R' AS mask, l_extendedprice AS value, l_quantity AS weight, l_discount, l_tax
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, suppliers = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    df = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select(
        F.col("s_nationkey").alias("animal"),
        F.year("l_shipdate").alias("day"),
        F.when(F.col("l_linestatus") == "F", "A").otherwise("B").alias("context"),
        (F.col("l_returnflag") == "A").alias("label"),
        F.col("l_quantity").alias("n_frames"),
    )
    return check_contract(df, "cells")


CELLS_SQL = """cells AS (
  SELECT s_nationkey AS animal, year(l_shipdate) AS day, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END AS context,
         l_returnflag = 'A' AS label, l_quantity AS n_frames
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: clicks and views as two raters' marks on a user's clip, in whole hours of 2024."""
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000)
    df = read(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    df = df.select(F.col("user_id").alias("clip"), F.col("event_type").alias("rater"), hour.cast("bigint").alias("frame")).distinct()
    return check_contract(df, "marks")


MARKS_SQL = """marks AS (
  SELECT DISTINCT user_id AS clip, event_type AS rater, (epoch_us(ts) - 1704067200000000) // 3600000000 AS frame
  FROM events WHERE event_type IN ('click', 'view'))"""
