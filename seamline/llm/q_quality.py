"""op10: quality rules over every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import quality
from seamline.llm.common import table

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"]


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*COLUMNS)


_R = quality.RULES
_PHRASES = " OR ".join(f"contains(low, '{p}')" for p in _R.phrases)
_COUNT = lambda c, marks: f"(length({c}) - length(translate({c}, '{marks}', '')))"

#: CTEs over a relation src(rid, text): per row the base counts and the verdict of the line rules.
JUDGED = f"""
words AS (
  SELECT rid, w, row_number() OVER (PARTITION BY rid ORDER BY pos) AS i
  FROM (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
        FROM (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM src)) u
), grams AS (
  SELECT rid, i, CASE WHEN lead(w, 4) OVER p IS NOT NULL
         THEN concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p) END AS g
  FROM words WINDOW p AS (PARTITION BY rid ORDER BY i)
), twice AS (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams WHERE g IS NOT NULL) c WHERE n > 1
), rep AS (
  SELECT rid, sum(least(coalesce(nxt - i, 5), 5)) AS n_repeat_words FROM twice GROUP BY rid
), wc AS (
  SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY rid
), lines AS (
  SELECT rid, k, line, length(line) AS n_line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n,
         lower(line) AS low
  FROM (SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM src)) u
), judged AS (
  SELECT *, ({_COUNT("line", "|»•·")} >= {_R.nav_marks} AND {_COUNT("line", "|»•·")} * {_R.nav_words} >= n)
       OR {_PHRASES}
       OR (n >= {_R.min_marked_words} AND {_COUNT("line", "#*$%&|<>")} * {_R.symbol_words} >= n)
       OR (n >= {_R.min_marked_words} AND regexp_matches(line, '[A-Z]') AND NOT regexp_matches(line, '[a-z]'))
       OR (n >= {_R.min_plain_words} AND {_COUNT("line", ".,;:!?…")} = 0) AS fails
  FROM lines
), lc AS (
  SELECT rid, sum(n_line) AS all_chars, coalesce(sum(n_line) FILTER (fails), 0) AS lost_chars,
         count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
         coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT fails), '') AS clean_text
  FROM judged GROUP BY rid
), verdict AS (
  SELECT rid, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         coalesce({_COUNT("text", "#*$%&|<>")}, 0)::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_words, 0) < {_R.min_words} OR 100 * coalesce(n_repeat_words, 0) > {_R.max_repeat_pct} * coalesce(n_words, 0) AS base_failed,
         lost_chars::BIGINT AS lost_chars, 100 * lost_chars > {_R.max_lost_pct} * all_chars AS lost_much, clean_text
  FROM src LEFT JOIN wc USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lc USING (rid)
)"""

ORACLE = {
    "op10_quality_rules": f"""
WITH src AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), {JUDGED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT lost_much AS kept, lost_chars
FROM src JOIN verdict USING (rid)"""
}
QUERIES = {"op10_quality_rules": op10_quality_rules}
