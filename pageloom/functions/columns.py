"""Columns encoded as whole numbers, and dates moved by years, months and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled(rows: DataFrame, column: str, bits: int, name: str) -> DataFrame:
    """rows with the column min-max scaled to 0 .. 2**bits - 1; a constant column is 0, null stays null."""
    ends = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    grid = F.when(F.col(column).isNotNull(), F.when(span == 0, F.lit(0)).otherwise(F.floor((F.col(column) - F.col("_lo")) / span * ((1 << bits) - 1)))).cast("long")
    return rows.crossJoin(F.broadcast(ends)).withColumn(name, grid).drop("_lo", "_hi")


def rank_encoded(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the place of the column's value among its different values in alphabetical order, from 0; null stays null."""
    from pageloom.operators.ranking import ranked

    values = rows.where(F.col(column).isNotNull()).select(F.col(column)).distinct()
    # ranges of a string column: by its text's order through the count of smaller ones in each range
    sized = values.withColumn("_key", F.conv(F.rpad(F.substring(F.hex(F.encode(F.col(column).cast("string"), "UTF-8")), 1, 12), 12, "0"), 16, 10).cast("double"))
    places = ranked(sized, "_key", column, name=name).drop("_key")
    return rows.join(places, column, "left")


def binary_text(number: Column, width: int) -> Column:
    """The number's binary digits, filled with zeros to the width."""
    return F.when(F.length(F.bin(number)) >= width, F.bin(number)).otherwise(F.lpad(F.bin(number), width, "0"))


def moved_date(date: Column, years: int = 0, months: int = 0, days: int = 0) -> Column:
    """The date moved by years and months, then by days; a month's end stays inside the month."""
    return F.date_add(F.add_months(date, 12 * years + months), days)
