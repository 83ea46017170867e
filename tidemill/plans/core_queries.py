"""Gathers the core's queries; importing a module registers what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans import search_queries, session_queries, store_queries, text_queries  # noqa: F401
from tidemill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["p4_found"](spark, sf_dir)
