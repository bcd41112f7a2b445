"""Inputs and reports: roots, content manifests, drift, frozen reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_in(roots: dict[str, str], root: str, *parts: str) -> str:
    if root not in roots:
        raise KeyError(f"unknown root {root!r}")
    return "/".join([roots[root].rstrip("/"), *parts])


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, length and SHA-256 of the whole of each file under a path; a file over 2 GB is an error, not an entry without digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def digest(entries: DataFrame) -> DataFrame:
    """One row: 16 hex digits over the sorted manifest."""
    line = F.concat_ws("\t", "name", "length", F.coalesce("sha256", F.lit("-")))
    return entries.agg(F.substring(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256), 1, 16).alias("digest"), F.count(F.lit(1)).alias("files"))


def drift(live: DataFrame, frozen: DataFrame) -> DataFrame:
    """Files that were added, removed or changed since a manifest was frozen."""
    a, b = live.select("name", F.struct("length", "sha256").alias("now")), frozen.select("name", F.struct("length", "sha256").alias("was"))
    both = a.join(b, "name", "full").where(~F.col("now").eqNullSafe(F.col("was")))
    return both.select("name", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


def freeze(df: DataFrame, path: str) -> None:
    """Write a report or manifest once, as JSON; a second time is an error."""
    df.write.mode("errorifexists").json(path)


def frozen(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
