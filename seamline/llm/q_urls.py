"""op11: a verdict on every page's url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import urls
from seamline.llm.common import table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op11_url_filter": op11_url_filter}
