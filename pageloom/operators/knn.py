"""k nearest neighbours: exact search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import vectors as V
from pageloom.operators import blocks

#: metric: (column of q and v, name of the result, sign that makes smaller better)
METRICS = {"l2": (V.l2, "distance", 1), "cosine": (V.cosine, "similarity", -1), "ip": (V.inner_product, "score", -1)}


def exact(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, rank, vec_id, value) of each query's k best vectors; ties go to the smaller id.

    Blocks of queries and vectors are compared by matrix products, of which each task keeps k rows a query. Keys are
    compared at nine decimals so that the order does not depend on the order in which an engine adds floats.
    """
    _, name, sign = METRICS[metric]
    found = blocks.nearest(queries, base, k, metric)
    order = Window.partitionBy("query_id").orderBy(F.round(F.lit(sign) * F.col("value"), 9), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.col("value").alias(name))


def nearest(base: DataFrame, query: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(vec_id, value) of one query's k best vectors: each task keeps k rows, no shuffle of the table."""
    fn, name, sign = METRICS[metric]
    scored = base.crossJoin(F.broadcast(query)).select("vec_id", fn(F.col("q"), F.col("v")).alias(name))
    return scored.orderBy(F.round(F.lit(sign) * F.col(name), 9), "vec_id").limit(k)


def recall(found: DataFrame, truth: DataFrame, k: int, queries: DataFrame | None = None, empty: float = 1.0) -> DataFrame:
    """(query_id, hits, recall) of (query_id, vec_id) results against the truth, for every query of either side and of `queries`.

    Where a query has no truth, its recall is `empty`.
    """
    ids = truth.select("query_id").unionByName(found.select("query_id"))
    ids = (ids if queries is None else ids.unionByName(queries.select("query_id"))).distinct()
    rows = truth.select("query_id", "vec_id").distinct().join(found.select("query_id", "vec_id", F.lit(1).alias("hit")).distinct(), ["query_id", "vec_id"], "left")
    counted = rows.groupBy("query_id").agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    share = F.when(F.coalesce("n", F.lit(0)) == 0, F.lit(float(empty))).otherwise(F.col("hits") / F.col("n"))
    return ids.join(counted, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), share.alias("recall"))


def probed(queries: DataFrame, cells: DataFrame, centres: DataFrame, probes: int, k: int, metric: str = "l2") -> DataFrame:
    """k nearest among the vectors of each query's `probes` nearest cells; cells is (vec_id, v, cid).

    Written by cid, the cells' table is pruned to the cells that are probed. Each part of a cell meets the queries that
    probe it in blocks; a query set up to blocks.SHARED_BYTES goes to every task, a larger one is joined by cell.
    """
    fn, name, sign = METRICS[metric]
    near = exact(queries, centres.select(F.col("cid").alias("vec_id"), F.col("c").alias("v")), probes).select("query_id", F.col("vec_id").alias("cid"))
    best = Window.partitionBy("query_id").orderBy(F.round(F.lit(sign) * F.col(name), 9), "vec_id")
    if probes * blocks.size_of(queries, "q")[1] > blocks.SHARED_BYTES:
        scored = cells.join(near.join(queries, "query_id"), "cid").select("query_id", "vec_id", fn(F.col("q"), F.col("v")).alias(name))
    else:
        keys, q = blocks.held(queries, "query_id", "q")
        by_cell: dict[int, list[int]] = {}
        for r in near.collect():  # `probes` rows a query of a checked set
            by_cell.setdefault(r["cid"], []).append(int(np.searchsorted(keys, r["query_id"])))
        shared = queries.sparkSession.sparkContext.broadcast((keys, q, {c: np.array(sorted(x)) for c, x in by_cell.items()}))

        def scan(batches):
            keys, q, by_cell = shared.value
            held = blocks.Best(len(keys), k, metric)
            for batch in batches:
                cid, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                v = blocks.matrix(batch.column(2))
                for c in np.unique(cid).tolist():
                    if c in by_cell:
                        rows, inside = by_cell[c], np.flatnonzero(cid == c)
                        row, found, value = blocks.nearest_in_block(q[rows], ids[inside], v[inside], k, metric)
                        held.add(rows[row], found, value)
            yield pa.RecordBatch.from_arrays([pa.array(keys[held.row]), pa.array(held.ids), pa.array(held.value)], ["query_id", "vec_id", name])

        used = cells.where(F.col("cid").isin(sorted(by_cell))).select(F.col("cid").cast("long"), F.col("vec_id").cast("long"), F.col("v").cast("array<double>"))
        scored = used.mapInArrow(scan, f"query_id long, vec_id long, {name} double")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", name)
