"""op3: all documents mixed to weights 3, 1, 2 of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import mixing
from seamline.llm.common import table


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op3_mix_sources": op3_mix_sources}
