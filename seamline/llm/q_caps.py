"""op6: links, components and survivors of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import caps
from seamline.llm.common import table


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = caps.link(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
