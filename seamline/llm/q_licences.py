"""op5: licence digests of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import licences as lic
from seamline.llm.common import table


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lic.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _canonical(c: str) -> str:
    low = lambda x: f"translate({x}, '{lic.UPPER}', '{lic.LOWER}')"
    named = f"length(x) <= {lic.SHORT} AND regexp_matches(x, '{lic.HOLDER_LINE}') AND NOT regexp_matches({low('x')}, '{lic.NO_HOLDER}')"
    lines = f"string_split(coalesce({c}, ''), chr(10))"
    t = low(f"array_to_string(list_concat(list_filter({lines}[1:{lic.HEAD}], lambda x: NOT ({named})), {lines}[{lic.HEAD + 1}:]), chr(10))")
    for line in (lic.COPYRIGHT_LINE, lic.RIGHTS_LINE):
        t = f"regexp_replace({t}, '{line}', chr(10), 'g')"
    t = f"' ' || regexp_replace({t}, '[^a-z0-9]+', ' ', 'g') || ' '"
    for old, new in lic.SPELLINGS:
        t = f"replace({t}, ' {old} ', ' {new} ')"
    return f"trim(regexp_replace({t}, '{lic.NAMED}', '{lic.NAMELESS}', 'g'), ' ')"


_KNOWN = ", ".join(f"('{d}', '{n}')" for d, n in lic.known_digests())
_NOTICES = ", ".join(sorted(f"('{lic.canonical_text(t)}', '{n}')" for n, ts in lic.NOTICES.items() for t in ts))

ORACLE = {
    "op5_license_scan": f"""
WITH known(digest, license_id) AS (VALUES {_KNOWN}), notice(line, name) AS (VALUES {_NOTICES}),
src AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
found AS (
  SELECT rid, list_sort(list(DISTINCT name)) AS notice_ids
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM src) l JOIN notice ON {_canonical("l.line")} = notice.line GROUP BY rid
)
SELECT doc_id, sha256({_canonical("text")}) AS canonical_sha256, license_id, coalesce(notice_ids, []) AS notice_ids
FROM src LEFT JOIN found USING (rid) LEFT JOIN known ON sha256({_canonical("text")}) = digest"""
}
QUERIES = {"op5_license_scan": op5_license_scan}
