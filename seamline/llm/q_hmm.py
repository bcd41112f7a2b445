"""op4: log10 probability of every document under the hidden Markov model and under the smoothed unigram base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import hmm
from seamline.llm.common import table


def op4_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op4_hmm_scoring": op4_hmm_scoring}
