"""The flagship query: the quality verdict of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .text_queries import web_quality


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score, quality, flags of every document."""
    return web_quality(spark, sf_dir)
