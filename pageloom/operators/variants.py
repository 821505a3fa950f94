"""Layouts by clusters of transformed vectors: which covariance, which gravity, clusters of any or of equal size.

Centres come from a function of the transformed rows: k-means, or anything that returns (cid, c).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import vectors as V
from pageloom.operators import blocks, matching, orders, stats, transforms
from pageloom.sources.scratch import stored

Centres = Callable[[DataFrame], DataFrame]


def kmeans(k: int, seed: int = 42) -> Centres:
    """Centres by k-means on the transformed rows."""

    def of(rows: DataFrame) -> DataFrame:
        found = transforms.kmeans_centres(rows, k, seed)
        return rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(found.tolist())], "cid long, c array<double>")

    return of


def stacked(base: DataFrame, queries: DataFrame) -> DataFrame:
    """(vec_id, v, src): the queries above the base; a query's id is -1 - query_id, so that none meets a vector's."""
    above = queries.select((-1 - F.col("query_id")).alias("vec_id"), F.col("q").alias("v"), F.lit("query").alias("src"))
    return above.unionByName(base.select("vec_id", "v", F.lit("base").alias("src")))


def exact_self_gravity(base: DataFrame, k: int = 3, t: float = 0.3) -> DataFrame:
    """(vec_id, v): every vector pulled by its k nearest others: x + t (1 + sum of dc d1 / d^2 (a - x)), dc the mean of all d1.

    Neighbours come from the block search, so no task holds more than blocks of vectors.
    """
    rows = base.select("vec_id", "v")
    near = blocks.nearest(rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), rows, k + 1, "l2")
    order = Window.partitionBy("query_id").orderBy((F.col("query_id") != F.col("vec_id")).cast("int"), F.round("value", 9), "vec_id")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r").between(2, k + 1))
    near = stored(near, "neighbours")  # k rows a vector; read for the mean and for the pulls
    dc = near.where("r = 2").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("dc"))  # one row
    first = F.min(F.struct("r", "value")).over(Window.partitionBy("query_id")).getField("value")
    pulls = near.withColumn("d1", first).join(rows.select("vec_id", F.col("v").alias("a")), "vec_id").crossJoin(F.broadcast(dc))
    weight = F.col("dc") * F.col("d1") / F.greatest(F.col("value") * F.col("value"), F.lit(1e-8))
    per = pulls.groupBy("query_id").agg(F.collect_list(F.struct("r", weight.alias("w"), "a")).alias("near"))  # k rows a vector
    joined = rows.join(per.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("near", F.array_sort(F.coalesce("near", F.array().cast("array<struct<r:int,w:double,a:array<double>>>"))))
    moved = F.transform("v", lambda x, i: x + F.lit(t) * (1 + F.aggregate("near", F.lit(0.0), lambda s, n: s + n.w * (F.get(n.a, i) - x))))
    return joined.select("vec_id", moved.alias("v"))


def clustered(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(vec_id, cid, pos): clusters by their centres' summed distances, members by distance to the centre."""
    return orders.kmeans_order(rows, centres)


def pulled_order(base: DataFrame, queries: DataFrame, centres: Centres, k: int = 3, t: float = 0.3) -> DataFrame:
    """No map: vectors pulled to the queries, then clustered."""
    x = transforms.gravity(base, "v", transforms.query_anchors(queries), k, t, keep=tuple(c for c in base.columns if c != "v"))
    return clustered(x, centres(x))


def joint_order(base: DataFrame, queries: DataFrame, dims: int, centres: Centres, k: int = 3, t: float = 0.3) -> DataFrame:
    """Mapped by the covariance of queries and vectors together, self gravity of both, the vectors clustered."""
    both = stacked(base, queries)
    x = transforms.linear(both, "v", transforms.adaptive_matrix(stats.covariance_matrix(both, "v", dims)), "vec_id", "src")
    x = transforms.gravity(x, "v", transforms.base_anchors(x), k, t, own=True, keep=("vec_id", "src"))
    x = x.where("src = 'base'").drop("src").join(base.drop("v"), "vec_id")
    return clustered(x, centres(x))


def query_map_order(base: DataFrame, queries: DataFrame, dims: int, centres: Centres, k: int, t: float = 0.3) -> DataFrame:
    """Mapped by the queries' covariance and pulled to as many mapped queries as there are clusters, then clustered."""
    a = transforms.adaptive_matrix(stats.covariance_matrix(queries, "q", dims))
    keep = tuple(c for c in base.columns if c != "v")
    anchors = transforms.query_anchors(transforms.linear(queries, "q", a, "query_id"))
    x = transforms.gravity(transforms.linear(base, "v", a, *keep), "v", anchors, k, t, keep=keep)
    return clustered(x, centres(x))


def stacked_order(base: DataFrame, queries: DataFrame, centres: Centres, k: int = 3, t: float = 0.3) -> DataFrame:
    """No map: self gravity of queries and vectors together, clusters of both, the queries dropped afterwards."""
    both = stacked(base, queries)
    x = transforms.gravity(both, "v", transforms.base_anchors(both), k, t, own=True, keep=("vec_id", "src"))
    c = centres(x)
    return orders.by_clusters(orders.assign(x, c).where("vec_id >= 0"), orders.centre_sums(c), "total", F.col("dist"))


# --- clusters of equal size -----------------------------------------------------------------------------------


def spread_sizes(n: int, k: int) -> list[int]:
    """n rows over k clusters: the first n mod k have one more."""
    return [n // k + (i < n % k) for i in range(k)]


def equal_size_labels(rows: DataFrame, centres: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """(vec_id, cid): vectors, in a scattered order, take their nearest centre that has room.

    Sizes add up to the rows at least (equal, the remainder over the first centres, if not given).
    """
    keys, c = blocks.held(centres, "cid", "c")  # as many as clusters
    n = rows.count()
    room = np.array(sizes or spread_sizes(n, len(keys)))
    if room.sum() < n:
        raise ValueError("the clusters have less room than there are vectors")
    order = ((F.col("vec_id") * 2654435761) % (1 << 32)).cast("double")
    choices = matching.nearest_choices(rows, c, len(c)).withColumn("d", F.transform("p", lambda _: order))
    found = matching.by_preferences(stored(choices, "equal-size"), room, many=False)
    names = rows.sparkSession.createDataFrame([(i, int(k)) for i, k in enumerate(keys)], "at int, cid long")
    return found.join(F.broadcast(names), "at").select("vec_id", "cid")


def by_labels(rows: DataFrame, labels: DataFrame, centres: DataFrame) -> DataFrame:
    """(vec_id, cid, pos): given clusters by their centres' summed distances, members by distance to the centre."""
    met = rows.select("vec_id", "v").join(labels, "vec_id").join(F.broadcast(centres), "cid").withColumn("dist", V.l2(F.col("v"), F.col("c")))
    return orders.by_clusters(met, orders.centre_sums(centres), "total", F.col("dist"))


def equal_pulled_order(base: DataFrame, queries: DataFrame, centres: Centres, k: int = 3, t: float = 0.3) -> DataFrame:
    """No map: vectors pulled to the queries, in clusters of equal size."""
    x = transforms.gravity(base, "v", transforms.query_anchors(queries), k, t, keep=tuple(c for c in base.columns if c != "v"))
    c = centres(x)
    return by_labels(x, equal_size_labels(x, c), c)


def equal_block_pull(base: DataFrame, queries: DataFrame, centres: Centres) -> DataFrame:
    """Clusters of equal size by their attraction to the mean query direction, members by angle to the centre."""
    c = centres(base)
    met = base.select("vec_id", "v").join(equal_size_labels(base, c), "vec_id").join(F.broadcast(c), "cid")
    return orders.by_clusters(met, orders.block_scores(met, stats.mean_direction(queries)), "score", 1 - V.cosine(F.col("v"), F.col("c")))


def farthest_cluster(queries: DataFrame, centres: DataFrame) -> DataFrame:
    """(query_id, q, cid): the queries of the cluster with the largest mean distance to its centre."""
    found = orders.assign(queries.select(F.col("query_id").alias("vec_id"), F.col("q").alias("v")), centres)
    means = found.groupBy("cid").agg(F.round(F.avg("dist"), 9).alias("m"))
    best = means.agg(F.max(F.struct("m", (-F.col("cid")).alias("neg"))).alias("b")).select((-F.col("b.neg")).alias("cid"))
    return found.join(F.broadcast(best), "cid", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "cid")


def counted_attraction_order(base: DataFrame, queries: DataFrame, centres: Centres, k: int = 3, t: float = 0.3) -> DataFrame:
    """A given number of clusters of equal size (the remainder over the first) on pulled, normalised vectors, by their
    attraction to the mean query direction, members by distance to the centre."""
    x = transforms.gravity(base, "v", transforms.query_anchors(queries), k, t, keep=tuple(c for c in base.columns if c != "v"))
    x = x.withColumn("v", V.normalise(F.col("v")))
    c = centres(x)
    met = x.select("vec_id", "v").join(equal_size_labels(x, c), "vec_id").join(F.broadcast(c), "cid").withColumn("dist", V.l2(F.col("v"), F.col("c")))
    return orders.by_clusters(met, orders.block_scores(met, stats.mean_direction(queries)), "score", F.col("dist"))


def joint_key_order(base: DataFrame, queries: DataFrame, dims: int, centres: Centres) -> DataFrame:
    """Vectors mapped by the covariance of queries and vectors together, by the distance to the own centre plus that
    centre's distances to all."""
    both = stacked(base, queries)
    x = transforms.linear(both, "v", transforms.adaptive_matrix(stats.covariance_matrix(both, "v", dims)), "vec_id", "src").where("src = 'base'").drop("src")
    x = x.join(base.drop("v"), "vec_id")
    return orders.centre_key_order(x, centres(x))


def first_component_order(base: DataFrame, dims: int) -> DataFrame:
    """(vec_id, key, pos): by the projection on the direction of largest variance. It stands in for a learned score; nothing
    is learned from queries."""
    _, vectors = transforms.eigen(stats.covariance_matrix(base, "v", dims))
    direction = F.array(*[F.lit(float(x)) for x in vectors[:, -1]])
    return orders.by_key(base, F.round(V.inner_product(F.col("v"), direction), 9))
