"""Tables written by partition label, read back by the partitions that can matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitions(rows: DataFrame, path: str, by: str = "bid") -> None:
    """One directory a label; a label's rows come together before they are written."""
    rows.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def relabel(rows: DataFrame, labels: DataFrame, on: str, path: str, by: str = "bid") -> None:
    write_partitions(rows.drop(by).join(labels.select(on, by), on), path, by)


def read_partitions(spark: SparkSession, path: str, parts: list | None = None, by: str = "bid") -> DataFrame:
    """The whole table, or the named partitions of it by a partition filter."""
    rows = spark.read.parquet(path)
    return rows if parts is None else rows.where(F.col(by).isin(parts))


def run_sql(spark: SparkSession, path: str, text: str, parts: list | None = None, view: str = "tbl") -> DataFrame:
    """Runs SQL text over `view`, the named partitions; with none named the result has the text's schema and sees no rows."""
    read_partitions(spark, path, parts).createOrReplaceTempView(view)
    return spark.sql(text)
