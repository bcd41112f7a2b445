"""op7: near-duplicate classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import minhash
from seamline.llm.common import table


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; rows that share doc_id and text are one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.classify(docs).select("doc_id", "n_shingles", "component_id", F.col("kept"))


QUERIES = {"op7_minhash_dedup": op7_minhash_dedup}
