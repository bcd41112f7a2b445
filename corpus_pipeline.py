"""Corpus pipeline: quality rules, near-duplicates, repeated passages, source mix, token ids.

Every stage takes what its predecessor wrote and read back; all but the last return the columns of ``documents``.
Counted as part of ``seamline.llm``.

Defined cases, in every stage: an empty table gives an empty one; a null doc_id comes before all others; further columns
pass through the first four stages, whatever their names. A null or empty text fails the quality rules, so later stages
of a run meet none; taken alone, they keep it (near_dedup: it is like no other; passage_dedup: nothing goes from it;
source_mix: it has no words and is taken once; token_ids: it has no ids). Repeated rows are judged alike in quality_rules;
they are one document in near_dedup and passage_dedup, which keep or drop them together; source_mix and token_ids take
them one by one. Texts are whole at any length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import bpe, minhash, mixing, quality, repeats
from seamline.llm.common import aside, shared_folder, table


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it now is."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed (op10)."""
    return quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates (op7)."""
    return minhash.keep_first(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of repeated 100-byte strings (op2); a document that nothing is left of goes."""
    plain, back = aside(docs, "doc_id", "text", "n_chars")
    out = repeats.remove(plain, give_text=True)
    return _recount(out.where("n_removed < n_bytes or n_bytes = 0").select(*back(docs.columns)))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (op3)."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each taken document, their number, and digests of them and of what they decode to (op1)."""
    return bpe.encode_documents(docs.select("doc_id", "source", "text"), ids=True, digests=True).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Signatures, suffix arrays and byte-pair merges are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes as soon as the next one stands."""
    docs = table(spark, sf_dir, "documents")
    home, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{home}/{k}-{name}")
        docs = spark.read.parquet(path)
        if last:
            _remove(spark, last)
        last = path
    return docs
