"""op2: repeated 100-byte strings removed from every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import repeats
from seamline.llm.common import table


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
