"""Orderings of the vectors: a layout is (vec_id, pos), positions from 0, ties by id.

Positions inside a cluster are ranks in it, and a cluster begins after all clusters before it, so no task sorts
the whole table. Orders by one key go through ranges of that key in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import vectors as V
from pageloom.operators import stats
from pageloom.operators.blocks import nearest_centres
from pageloom.operators.ranking import ranked

#: Keys are compared at nine decimals: the order then does not depend on how an engine adds floats.
DECIMALS = 9


def _key(c: Column) -> Column:
    return F.round(c, DECIMALS)


def assign(base: DataFrame, centres: DataFrame) -> DataFrame:
    """(vec_id, v, cid, c, dist): base with the nearest centre; ties go to the smaller cid."""
    return nearest_centres(base, centres)


def centre_sums(centres: DataFrame, distance: Callable[[Column, Column], Column] = V.l2) -> DataFrame:
    """(cid, total): each centre's distances to all centres, added up."""
    other = centres.select(F.col("cid").alias("cid2"), F.col("c").alias("c2"))
    return centres.crossJoin(F.broadcast(other)).groupBy("cid").agg(F.sum(distance(F.col("c"), F.col("c2"))).alias("total"))


def by_clusters(assigned: DataFrame, clusters: DataFrame, score: str, key: Column) -> DataFrame:
    """(vec_id, cid, pos): clusters by their score, members by key; clusters without a score come last."""
    sizes = assigned.groupBy("cid").agg(F.count("*").alias("size"))
    ranked = sizes.join(clusters, "cid", "left")
    before = Window.orderBy(F.asc_nulls_last(_key(F.col(score))), "cid").rowsBetween(Window.unboundedPreceding, -1)  # a row a cluster
    starts = ranked.select("cid", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("cid").orderBy(_key(key), "vec_id")
    ranks = assigned.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranks.join(F.broadcast(starts), "cid").select("vec_id", "cid", (F.col("start") + F.col("_rank")).cast("long").alias("pos"))


def by_key(rows: DataFrame, key: Column) -> DataFrame:
    """(vec_id, key, pos): positions in the order of (key, vec_id)."""
    return ranked(rows.select("vec_id", key.alias("key")), "key", "vec_id", name="pos")


def kmeans_order(base: DataFrame, centres: DataFrame) -> DataFrame:
    """Clusters by their centres' summed distances, members by distance to the centre."""
    return by_clusters(assign(base, centres), centre_sums(centres), "total", F.col("dist"))


def cosine_order(base: DataFrame, centres: DataFrame) -> DataFrame:
    """The same with angular distances."""

    def angular(a: Column, b: Column) -> Column:
        return 1 - V.cosine(a, b)

    return by_clusters(assign(base, centres), centre_sums(centres, angular), "total", 1 - V.cosine(F.col("v"), F.col("c")))


def angular_pull_order(base: DataFrame, centres: DataFrame, qbar: DataFrame, lam: float = 0.3) -> DataFrame:
    """Angular clusters; members are pulled to the mean query direction by lam."""

    def angular(a: Column, b: Column) -> Column:
        return 1 - V.cosine(a, b)

    rows = assign(base, centres).crossJoin(F.broadcast(qbar))
    key = 1 - V.cosine(F.col("v"), F.col("c")) - F.lit(lam) * V.cosine(F.col("v"), F.col("qbar"))
    return by_clusters(rows, centre_sums(centres, angular), "total", key)


def block_scores(assigned: DataFrame, qbar: DataFrame) -> DataFrame:
    """(cid, score): the smallest angular distance of a member to the mean query direction."""
    return assigned.crossJoin(F.broadcast(qbar)).groupBy("cid").agg(F.min(1 - V.cosine(F.col("v"), F.col("qbar"))).alias("score"))


def attraction_order(base: DataFrame, centres: DataFrame, qbar: DataFrame, angular: bool = False) -> DataFrame:
    """Blocks by their attraction to the queries, members by distance to the centre (angular: by cosine)."""
    rows = assign(base, centres)
    key = 1 - V.cosine(F.col("v"), F.col("c")) if angular else F.col("dist")
    return by_clusters(rows, block_scores(rows, qbar), "score", key)


def idistance_order(base: DataFrame, centres: DataFrame) -> DataFrame:
    """One key: the rank of the centre's norm times the spread of all values, plus the distance to the centre."""
    ranks = centres.select("cid", (F.row_number().over(Window.orderBy(_key(V.norm(F.col("c"))), "cid")) - 1).alias("_r"))  # a row a centre
    spread = base.agg((F.max(F.array_max("v")) - F.min(F.array_min("v"))).alias("ptp"))
    rows = assign(base, centres).join(F.broadcast(ranks), "cid").crossJoin(F.broadcast(spread))
    return by_key(rows, _key(F.col("_r") * (F.col("ptp") + 1e-6) + F.col("dist")))


def centre_key_order(base: DataFrame, centres: DataFrame) -> DataFrame:
    """Key: distance to the own centre plus that centre's summed distances."""
    rows = assign(base, centres).join(F.broadcast(centre_sums(centres)), "cid")
    return by_key(rows, _key(F.col("dist") + F.col("total")))


def morton(grid: Column, dims: int, bits: int) -> Column:
    """Bit b of dimension d at place b * dims + d, as a long; dims * bits is at most 62."""
    if dims * bits > 62:
        raise ValueError("use morton_binary for keys above 62 bits")
    out = F.lit(0).cast("long")
    for b in range(bits):
        for d in range(dims):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(grid[d], b).bitwiseAND(F.lit(1)).cast("long"), b * dims + d))
    return out


def z_order(base: DataFrame, dims: int, bits: int) -> DataFrame:
    """Z-order over the first `dims` dimensions, each on a grid of 2**bits."""
    ends = stats.minmax(base.select(F.slice("v", 1, dims).alias("v")))
    rows = base.crossJoin(F.broadcast(ends))
    grid = F.array(*[V.quantise(F.col("v")[d], F.col("lo")[d], F.col("hi")[d], bits) for d in range(dims)])
    return by_key(rows, morton(grid, dims, bits))


def scattered_order(base: DataFrame, factor: int = 2654435761, modulus: int = 1 << 32) -> DataFrame:
    """A fixed scattering of the ids: the baseline without locality."""
    return by_key(base, (F.col("vec_id") * F.lit(factor)) % F.lit(modulus))


def posting_order(layout: DataFrame, members: DataFrame, access: DataFrame | None = None) -> DataFrame:
    """(posting_id, score, first_pos, ord): postings by score (largest first), first position, then id."""
    rows = members.join(layout.select("vec_id", "pos"), "vec_id")
    rows = rows.join(access, "vec_id", "left") if access is not None else rows.withColumn("access_score", F.lit(0.0))
    scored = rows.groupBy("posting_id").agg(F.sum(F.coalesce("access_score", F.lit(0.0))).alias("score"), F.min("pos").alias("first_pos"))
    order = Window.orderBy(F.desc(_key(F.col("score"))), "first_pos", "posting_id")  # a row a posting
    return scored.withColumn("ord", (F.row_number().over(order) - 1).cast("long"))
