"""op12: conversations damaged by a fixed rule, then repaired."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import repair
from seamline.llm.common import arrow_map, table
from seamline.llm.sql_crc import crc, crc_table

NOTHING = hashlib.sha256(b"").hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """By CRC of ``conv_id:turn`` modulo 20: 0 drops a row (``live`` is false), 1 empties the text, 2 removes its full stops,
    3 repeats the row (``copy``), 4 makes it the user's."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h, text = F.col("h"), F.coalesce("text", F.lit(" "))
    hashed = turns.select("conv_id", "turn", "role", "text", F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")), F.lit(20)).alias("h"))
    return hashed.select(
        "conv_id",
        "turn",
        F.when(h == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (h != 0).alias("live"),
    )


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of sorted turns, as they stream by: ``role:text``, joined by newlines."""
    kind = turns.schema["conv_id"].dataType

    def run(batches):
        at, sha = None, None
        for b in batches:
            done = []
            for who, place, role, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if place == 0:
                    if sha:
                        done.append((at, sha.hexdigest()))
                    at, sha = who, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield _block(b.schema.field(0).type, done)
        if sha:
            yield _block(b.schema.field(0).type, [(at, sha.hexdigest())])

    return arrow_map(turns.select("conv_id", "place", "role", "text"), run, f"conv_id {kind.simpleString()}, repaired_sha256 string")


def _block(kind, rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "repaired_sha256"])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_digests(damaged(table(spark, sf_dir, "conversations")))


def repaired_digests(turns: DataFrame) -> DataFrame:
    found = repair.audits(turns, "copy", "live")
    shas = digests(repair.repaired(turns, found, "copy", "live")).withColumnRenamed("conv_id", "of")
    out = found.join(shas, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return out.select(*repair.AUDIT, F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = {
    "op12_conversation_repair": f"""
WITH RECURSIVE {crc_table()}, hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE h <> 0
), placed AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         ltrim(text, {_WHITE}) = '' AS blank, right(rtrim(text, {_WHITE}), 1) NOT IN ('.', '!', '?') AS cut
  FROM damaged
), judged AS (
  SELECT *, NOT blank AND nth > 1 AS again, NOT blank AND nth = 1 AND cut AS short,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again) AS duplicate, count(*) FILTER (short) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY 1
), inserts(was, now, many, said) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, chr(10) || 'user:'), (1, 2, 1, chr(10) || 'user:'), (3, 2, 1, chr(10) || 'user:'),
         (2, 3, 1, chr(10) || 'assistant:'), (0, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 2, chr(10) || 'user:' || chr(10) || 'assistant:')
), moves AS (
  SELECT j.conv_id, j.k, s.was, e.edit,
         CASE e.edit WHEN 'D' THEN s.was WHEN 'K' THEN CASE j.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE s.was WHEN 2 THEN 3 ELSE 2 END END AS now,
         CASE e.edit WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN short AND e.edit <> 'D' THEN 3 ELSE 0 END AS cost,
         CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE s.was WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || text END AS said
  FROM judged j, (VALUES (0), (1), (2), (3)) s(was), (VALUES ('D'), ('K'), ('R')) e(edit)
  WHERE e.edit = 'D' OR NOT (blank OR again) AND (e.edit = 'R' OR initial = 's' AND s.was = 0 OR initial = 'u' AND s.was <> 2 OR initial = 'a' AND s.was = 2)
), path AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS role, {{'cost': 0, 'audit': '', 'said': ''}} AS best FROM conversations
  UNION ALL
  SELECT p.conv_id, m.k, m.now, min({{'cost': p.best.cost + 3 * i.many + m.cost, 'audit': p.best.audit || repeat('I', i.many) || m.edit, 'said': p.best.said || i.said || m.said}})
  FROM path p JOIN inserts i ON i.was = p.role JOIN moves m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.k = p.k + 1 AND m.was = i.now
  GROUP BY 1, 2, 3
), done AS (
  SELECT p.conv_id, min({{'cost': p.best.cost + 3 * i.many, 'audit': p.best.audit || repeat('I', i.many), 'said': p.best.said || i.said}}) AS best
  FROM path p JOIN inserts i ON i.was = p.role LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id
  WHERE p.k = coalesce(c.n, 0) AND i.now IN (0, 3) GROUP BY 1
)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, d.best.cost::BIGINT AS cost, d.best.audit AS audit, sha256(substring(d.best.said, 2)) AS repaired_sha256
FROM done d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id"""
}
QUERIES = {"op12_conversation_repair": op12_conversation_repair}
