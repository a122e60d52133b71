"""Queries for packed values, the one core problem of training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coursegrain.operators.packed import packed_values
from coursegrain.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return packed_values(table(spark, d, "triples", "triple_id", "source_slides", "source_chunks"), "triple_id", ["source_slides", "source_chunks"], least=2)


P4_SQL = r"""
WITH f AS (
  SELECT triple_id, 'source_slides' AS field, source_slides AS v FROM triples
  UNION ALL SELECT triple_id, 'source_chunks', source_chunks FROM triples
), t AS (
  SELECT triple_id, field, list_filter(list_transform(
      regexp_extract_all(v, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|“[^”]*”|«[^»]*»|‘[^’]*’|[A-Za-z0-9#._\-]+'),
      lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') WHEN x[1] = '''' THEN replace(x[2:-2], '''''', '''')
                WHEN x[1] IN ('“', '«', '‘') THEN x[2:-2] WHEN lower(x) = 'and' THEN '' ELSE x END), lambda x: x <> '') AS items
  FROM f WHERE v IS NOT NULL
)
SELECT triple_id, field, CAST(unnest(generate_series(1, len(items))) AS BIGINT) AS pos, unnest(items) AS item FROM t WHERE len(items) >= 2
"""

QUERIES = {"p4_found": p4_found}
SQL = {"p4_found": P4_SQL}
