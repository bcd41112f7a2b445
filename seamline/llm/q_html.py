"""op9: main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import html_text
from seamline.llm.common import table


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op9_html_extraction": op9_html_extraction}
