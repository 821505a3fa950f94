"""Readers for the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def base_vectors(spark: SparkSession, root: str) -> DataFrame:
    """(vec_id, v): every stored vector, in double."""
    rows = table(spark, root, "embeddings")
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def query_stream(spark: SparkSession, root: str, every: int = 10) -> DataFrame:
    """(query_id, q): the vectors whose id is a multiple of `every`, numbered in arrival order."""
    rows = base_vectors(spark, root).where(F.col("vec_id") % every == 0)
    return rows.select(F.expr(f"vec_id div {every}").alias("query_id"), F.col("v").alias("q"))
