"""Every query of the core library by name, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxgrid.operators.timestamps import p2_found
from voxgrid.plans import evaluation_queries, funnel_queries, scope_queries, summary_queries, text_queries  # noqa: F401
from voxgrid.plans.registry import ORACLE, QUERIES, query

query()(p2_found)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, mean score and sentiment counts of every platform."""
    return summary_queries.platform_stats(spark, sf_dir)


__all__ = ["ORACLE", "QUERIES", "flagship"]
