"""Pages of a layout, their zone maps, and how many of them a query touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import id_list


def paged(layout: DataFrame, capacity: int) -> DataFrame:
    """layout with page_id: `capacity` positions a page."""
    if capacity < 1:
        raise ValueError("a page holds at least one vector")
    return layout.withColumn("page_id", F.floor(F.col("pos") / capacity).cast("long"))


def page_map(layout: DataFrame, capacity: int) -> DataFrame:
    """(page_id, members): the ids of each page in physical order."""
    rows = paged(layout, capacity).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "vec_id"))).alias("m"))
    return rows.select("page_id", F.col("m.vec_id").alias("members"))


def equal_count_labels(pos: Column, n: int, k: int) -> Column:
    """k labels of n div k + 1 positions each; the last takes what is left."""
    return F.least(F.floor(pos / (n // k + 1)).cast("long"), F.lit(k - 1))


def zone_map(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, lo, hi, size)."""
    return rows.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("size"))


def blocks_of(ids: Column, block: int) -> Column:
    """The number of different blocks behind an array of positions."""
    return F.size(F.array_distinct(F.transform(ids, lambda i: F.floor(i / block)))).cast("long")


def touched_pages(results: DataFrame, layout: DataFrame, capacity: int, *keys: str) -> DataFrame:
    """(keys, pages, vectors): pages behind result rows that name vec_id."""
    rows = results.join(paged(layout, capacity).select("vec_id", "page_id"), "vec_id")
    return rows.groupBy(*keys).agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("vectors"))


def static_report(log: DataFrame, ids: str | list[str], block: int, **equal) -> DataFrame:
    """The log's rows that match the settings, with block_num for each id-list column."""
    columns = [ids] if isinstance(ids, str) else ids
    rows = log
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    names = {c: "block_num" if len(columns) == 1 else f"block_num_{c}" for c in columns}
    return rows.withColumns({names[c]: blocks_of(id_list(F.col(c)), block) for c in columns})


def report_average(report: DataFrame, column: str = "block_num") -> DataFrame:
    return report.agg(F.avg(column).alias("avg_block"), F.count("*").alias("rows"))


def probe_windows(log: DataFrame, windows: int, seat: int) -> DataFrame:
    """(window_id, upto_seat, at_seat) for every window 0 .. windows - 1: blocks of probes 1 .. seat and of probe seat."""
    spark = log.sparkSession
    rows = log.where(F.col("window_id").between(0, windows - 1)).groupBy("window_id")
    sums = rows.agg(
        F.sum(F.when(F.col("num_probes").between(1, seat), F.col("block_num")).otherwise(0)).alias("upto_seat"),
        F.sum(F.when(F.col("num_probes") == seat, F.col("block_num")).otherwise(0)).alias("at_seat"),
    )
    every = spark.range(windows).withColumnRenamed("id", "window_id")
    return every.join(sums, "window_id", "left").select("window_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("upto_seat", "at_seat")])


def row_windows(log: DataFrame, row: str, size: int) -> DataFrame:
    """(window_id from 1, avg_block, total_block): full windows of `size` consecutive rows, rows numbered from 0."""
    w = (F.floor(F.col(row) / size) + 1).cast("long")
    grouped = log.groupBy(w.alias("window_id")).agg(F.count("*").alias("n"), F.avg("block_num").alias("avg_block"), F.sum("block_num").alias("total_block"))
    return grouped.where(F.col("n") == size).drop("n")


def window_totals(log: DataFrame) -> DataFrame:
    """(window_id, rows_in_window, avg_block at six decimals, total_block)."""
    return log.groupBy("window_id").agg(F.count("*").alias("rows_in_window"), F.round(F.avg("block_num"), 6).alias("avg_block"), F.sum("block_num").alias("total_block"))


def check_layout(layout: DataFrame, capacity: int) -> None:
    """Raises unless positions are 0 .. n - 1, each once, with different ids."""
    r = layout.agg(F.count("*").alias("n"), F.count_distinct("pos").alias("p"), F.count_distinct("vec_id").alias("v"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()
    if r["n"] and (r["p"] != r["n"] or r["v"] != r["n"] or r["lo"] != 0 or r["hi"] != r["n"] - 1):
        raise ValueError("not a permutation of the vectors")
    if capacity < 1:
        raise ValueError("a page holds at least one vector")
