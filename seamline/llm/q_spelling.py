"""op13: words of all documents, grouped with their spelling variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import spelling
from seamline.llm.common import table
from seamline.llm.sql_crc import crc, crc_table

DAMAGE = 199


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.group_variants(docs, damage=DAMAGE).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = {
    "op13_spelling_variants": f"""
WITH RECURSIVE {crc_table()}, runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
), of_doc AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY 1, 2
), hashed AS (
  SELECT run, n, {crc("doc_id || ':' || run")} AS h FROM of_doc, crc_table
), words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5
), holes AS (
  SELECT word, n, length(word) AS size, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
  FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, min({{'n': -other_n, 'word': other}}) AS best FROM near GROUP BY 1
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
         CASE WHEN -b.best.n >= 5 * w.n THEN b.best.word END AS form, CASE WHEN -b.best.n >= 5 * w.n THEN -b.best.n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, form AS at FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.at AS root FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n::BIGINT AS form_n FROM formed LEFT JOIN roots USING (word)"""
}
QUERIES = {"op13_spelling_variants": op13_spelling_variants}
