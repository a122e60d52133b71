"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coursegrain.plans import cards, checks, graph, lesson, tagged, training

QUERIES = {k: q for m in (lesson, cards, graph, tagged, checks, training) for k, q in m.QUERIES.items()}
SQL = {k: q for m in (lesson, cards, graph, tagged, checks, training) for k, q in m.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Facts grouped by what they say, with the best row and all slides of each group."""
    return QUERIES["agg4_fact_groups"](spark, d)
