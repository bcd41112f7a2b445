"""op1: every document encoded and decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import bpe
from seamline.llm.common import table


def op1_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ids=False, digests=True)


QUERIES = {"op1_bpe_encoding": op1_bpe_encoding}
