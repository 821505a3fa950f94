"""Ranks in large groups without one task a group: ranges of the value first, then ranks inside a range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, value: str, tie: str, group: tuple[str, ...] = (), ranges: int = 64, name: str = "rank") -> DataFrame:
    """rows with `name`: the position from 0 in the order of (value, tie), in each group.

    Boundaries are approximate quantiles of the value (a row a group is broadcast), positions are exact:
    the rows of lower ranges are counted and added to the rank inside the range.
    """
    parts = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = rows.groupBy(*group).agg(F.percentile_approx(F.col(value), parts, F.lit(10000)).alias("_cuts"))
    met = rows.join(F.broadcast(cuts), list(group)) if group else rows.crossJoin(F.broadcast(cuts))
    # the number of boundaries below the value
    met = met.withColumn("_part", F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col(value)))).drop("_cuts")
    counts = met.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most `ranges` rows a group
    starts = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_part").orderBy(value, tie)
    out = met.withColumn("_rank", F.row_number().over(inside) - 1).join(F.broadcast(starts), [*group, "_part"])
    return out.withColumn(name, (F.col("_start") + F.col("_rank")).cast("long")).drop("_rank", "_start", "_part")
