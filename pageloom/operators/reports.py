"""Recall, access and cost reports over experiments: results of several tables for the same queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.operators import knn, pages


def layout_knn(queries: DataFrame, base: DataFrame, layout: DataFrame, capacity: int, k: int) -> DataFrame:
    """(query_id, rank, page_id, vec_id, distance, pages_read): a search of the whole layout.

    Ties go by page, then by id. A full search reads every page, and says so.
    """
    near = knn.exact(queries, base, k)
    met = near.join(pages.paged(layout, capacity).select("vec_id", "page_id"), "vec_id")
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "page_id", "vec_id")
    total = layout.agg((F.max("pos").cast("long") / capacity).alias("p")).select((F.floor("p") + 1).alias("pages_read"))
    return met.withColumn("rank", F.row_number().over(order).cast("long")).crossJoin(F.broadcast(total)).select("query_id", "rank", "page_id", "vec_id", "distance", "pages_read")


def experiment(queries: DataFrame, tables: dict[str, DataFrame], truth: DataFrame, ks: list[int], metric: str = "l2") -> DataFrame:
    """(table_name, k, query_id, ids, recall): every table searched for every k, against the truth's first k. An empty truth is recall 0."""
    out = None
    top = max(ks)
    for name, base in tables.items():
        near = knn.exact(queries, base, top, metric)
        for k in ks:
            found = near.where(F.col("rank") <= k)
            own = knn.recall(found, truth.where(F.col("rank") <= k), k, queries, empty=0.0)
            ids = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda s: s.vec_id.cast("string")), " ").alias("ids"))
            one = own.join(ids, "query_id", "left").select(F.lit(name).alias("table_name"), F.lit(k).alias("k"), "query_id", F.coalesce("ids", F.lit("")).alias("ids"), "recall")
            out = one if out is None else out.unionByName(one)
    return out


def by_table(log: DataFrame, table: str, cost: str, recall: str) -> DataFrame:
    """(table, runs, total_cost, average_cost, average_recall)."""
    return log.groupBy(table).agg(F.count("*").alias("runs"), F.sum(cost).alias("total_cost"), F.avg(cost).alias("average_cost"), F.avg(recall).alias("average_recall"))


def replay_totals(events: DataFrame, searches: DataFrame) -> DataFrame:
    """One row: costs, switches, and over the windows whose chosen layout is partial the queries, fallbacks and mean recall.

    events is a window's choice; searches is (window_id, query_id, fallback, recall) of the partial layouts.
    """
    mine = searches.join(events.where(F.col("layout_label") == "partial").select("window_id"), "window_id")
    seen = mine.agg(F.count("*").alias("query_count"), F.count_if("fallback").alias("fallback_count"), F.avg("recall").alias("mean_recall"))
    total = events.agg(F.sum("query_cost").alias("total_query_cost"), F.sum("movement_cost").alias("total_movement_cost"), F.count_if("switched").alias("switch_count"), F.count("*").alias("window_count"))
    return total.crossJoin(F.broadcast(seen))


def jaccard_distance(a: DataFrame, b: DataFrame, on: str, label: str) -> DataFrame:
    """One row: 1 - the mean over a's groups of the best Jaccard overlap with a group of b."""
    left = a.select(on, F.col(label).alias("x"))
    right = b.select(on, F.col(label).alias("y"))
    both = left.join(right, on).groupBy("x", "y").agg(F.count("*").alias("n"))
    sizes = both.join(left.groupBy("x").agg(F.count("*").alias("nx")), "x").join(right.groupBy("y").agg(F.count("*").alias("ny")), "y")
    best = sizes.groupBy("x").agg(F.max(F.col("n") / (F.col("nx") + F.col("ny") - F.col("n"))).alias("j"))
    return best.agg((1 - F.avg("j")).alias("distance"))


def partition_budget(files: DataFrame, k: int, equal: bool = False) -> DataFrame:
    """(file, parts): k partitions dealt to files by their sizes (or evenly), at least one each; what rounding leaves goes to the
    largest remainders. Files are few and come as (file, size)."""
    count = files.agg(F.count("*").alias("m"), F.sum("size").alias("total"))
    share = F.lit(1.0) / F.col("m") if equal else F.col("size") / F.col("total")
    rows = files.crossJoin(F.broadcast(count)).withColumn("want", share * (F.lit(k) - F.col("m")))
    rows = rows.withColumn("own", F.floor("want").cast("long") + 1).withColumn("rest", F.round(F.col("want") - F.floor("want"), 9))
    left = F.lit(k) - F.sum("own").over(Window.partitionBy())  # a row a file
    place = F.row_number().over(Window.orderBy(F.desc("rest"), "file"))
    return rows.withColumn("left", left).withColumn("place", place).select("file", (F.col("own") + (F.col("place") <= F.col("left")).cast("long")).alias("parts"))


def positives(samples: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(query_id, vec_id, positive): whether a sampled vector is among the query's neighbours."""
    marked = neighbours.select("query_id", "vec_id", F.lit(True).alias("hit")).distinct()
    return samples.join(marked, ["query_id", "vec_id"], "left").select("query_id", "vec_id", F.coalesce("hit", F.lit(False)).alias("positive"))


def unassigned(ids: DataFrame, members: DataFrame) -> DataFrame:
    """The ids that no membership names."""
    return ids.select("vec_id").distinct().join(members.select("vec_id"), "vec_id", "left_anti")


def in_layout_order(base: DataFrame, layout: DataFrame) -> DataFrame:
    """(pos, vec_id, v): the vectors gathered into a layout's order."""
    return layout.select("vec_id", "pos").join(base.select("vec_id", "v"), "vec_id").select("pos", "vec_id", "v")


def repeated_rows(rows: DataFrame, key: str, every: int, times: int) -> DataFrame:
    """Hot-start data: every `every`-th row, `times` over, below the rows themselves; copies are told apart by `copy`, 0 for the rows."""
    hot = rows.where(F.col(key) % every == 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return rows.withColumn("copy", F.lit(0)).unionByName(hot)


def tiled(queries: DataFrame, n: int, total: int) -> DataFrame:
    """(tile_id, query_id): `total` queries by going through the n given ones again and again."""
    copies = -(-total // max(n, 1))
    rows = queries.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return rows.select((F.col("copy") * n + F.col("query_id")).cast("long").alias("tile_id"), "query_id").where(F.col("tile_id") < total)
