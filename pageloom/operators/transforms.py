"""Vector transforms: the covariance map, gravity towards anchors, and the query-attracted layout made of them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import vectors as V
from pageloom.operators import matching, stats


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending, not below 0) and eigenvectors; each vector's largest entry is positive."""
    values, vectors = np.linalg.eigh(cov)
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    return np.maximum(values, 0), vectors * np.where(sign == 0, 1, sign)


def adaptive_matrix(cov: np.ndarray) -> np.ndarray:
    """Covariance times eigenvectors times the roots of the eigenvalues."""
    values, vectors = eigen(cov)
    return cov @ vectors @ np.diag(np.sqrt(values))


def mapped(rows: DataFrame, vector: str, fn, *keep: str) -> DataFrame:
    """rows with the vector replaced by fn of an (n, d) float64 block, batch by batch."""
    schema = ", ".join([*(f"`{c}` {dict(rows.dtypes)[c]}" for c in keep), f"`{vector}` array<double>"])

    def run(batches):
        for batch in batches:
            column = batch.column(len(keep))
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            out = np.ascontiguousarray(fn(x), np.float64)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (out.shape[1] if len(out) else 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], [*keep, vector])

    return rows.select(*keep, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, schema)


def linear(rows: DataFrame, vector: str, a: np.ndarray, *keep: str) -> DataFrame:
    """x . A; the matrix is d x d and travels with the task."""
    return mapped(rows, vector, lambda x: x @ a, *keep)


def farthest_points(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of k points, each the farthest from those before; the first is the first row."""
    chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(k, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return np.array(chosen)


def anchor_count(n: int, low: int = 8, high: int = 128) -> int:
    return min(n, max(low, min(high, math.ceil(4 * math.log(max(n, 2))))))


def spread_out(rows: DataFrame, key: str, vector: str, low: int, high: int) -> np.ndarray:
    """The farthest points of all rows, from that with the smallest key on; ties go to the smaller key.

    An aggregate a point: each task sends the farthest of its rows, so the driver holds the points only.
    """
    held = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).persist()
    try:
        k = anchor_count(held.count(), low, high)
        chosen = [np.array(r["v"]) for r in held.orderBy("id").limit(min(k, 1)).collect()]
        while len(chosen) < k:

            def run(batches, points=tuple(chosen)):
                best = None
                for batch in batches:
                    if batch.num_rows:
                        ids = batch.column(0).to_numpy(zero_copy_only=False)
                        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                        far = np.min([np.linalg.norm(x - p, axis=1) for p in points], axis=0)
                        at = np.lexsort((ids, -far))[0]
                        best = min(best or (np.inf, 0, None), (-far[at], int(ids[at]), x[at]), key=lambda b: b[:2])
                if best:
                    yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]]), pa.array([best[2].tolist()])], ["d", "id", "v"])

            # a row a task
            found = min(held.mapInArrow(run, "d double, id long, v array<double>").collect(), key=lambda r: (r["d"], r["id"]))
            chosen.append(np.array(found["v"]))
    finally:
        held.unpersist()
    return np.array(chosen, np.float64)


def query_anchors(queries: DataFrame, vector: str = "q") -> np.ndarray:
    """8 to 128 spread-out queries, chosen from all of them."""
    return spread_out(queries, "query_id", vector, 8, 128)


def base_anchors(base: DataFrame, vector: str = "v") -> np.ndarray:
    """16 to 256 spread-out vectors, chosen from all of them."""
    return spread_out(base, "vec_id", vector, 16, 256)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
    return np.sqrt(np.maximum(d, 0))


def scale_of(anchors: np.ndarray) -> float:
    d = _distances(anchors, anchors)
    np.fill_diagonal(d, 0)
    return float(d[d > 0].mean()) if (d > 0).any() else 1.0


def towards_queries(x: np.ndarray, anchors: np.ndarray, k: int = 3, t: float = 0.3) -> np.ndarray:
    """x + t (1 + sum over the k nearest anchors of dc / d^2 (anchor - x))."""
    d = _distances(x, anchors)
    near = np.argsort(d, 1, kind="stable")[:, : min(k, len(anchors))]
    w = scale_of(anchors) / np.maximum(np.take_along_axis(d, near, 1) ** 2, 1e-8)
    return x + t * (1 + (w[:, :, None] * (anchors[near] - x[:, None])).sum(1))


def towards_selves(x: np.ndarray, anchors: np.ndarray, dc: float, k: int = 3, t: float = 0.3) -> np.ndarray:
    """The nearest anchor, pulled by the next k: a0 + t (1 + sum of dc d1 / d^2 (a - a0))."""
    d = _distances(x, anchors)
    near = np.argsort(d, 1, kind="stable")[:, : min(k + 1, len(anchors))]
    far = np.take_along_axis(d, near, 1)
    a0 = anchors[near[:, 0]]
    if near.shape[1] == 1:
        return a0 + t
    w = dc * far[:, 1:2] / np.maximum(far[:, 1:] ** 2, 1e-8)
    return a0 + t * (1 + (w[:, :, None] * (anchors[near[:, 1:]] - a0[:, None])).sum(1))


def gravity(rows: DataFrame, vector: str, anchors: np.ndarray, k: int = 3, t: float = 0.3, own: bool = False, *, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Gravity of all rows towards at most a few hundred anchors; own takes the transform among the rows themselves."""
    if not own:
        return mapped(rows, vector, lambda x: towards_queries(x, anchors, k, t), *keep)
    second = mapped(rows, vector, lambda x: np.sort(_distances(x, anchors), 1)[:, min(1, len(anchors) - 1)][:, None], *keep)
    dc = second.agg(F.avg(F.col(vector)[0])).first()[0] or 1.0
    return mapped(rows, vector, lambda x: towards_selves(x, anchors, dc, k, t), *keep)


def assign_blocks(rows: DataFrame, centres: np.ndarray, capacity: int, nearest: int = 5) -> DataFrame:
    """(vec_id, cid): blocks of at most `capacity`, pairs of vector and near centre taken by distance, in rounds on the executors."""
    return matching.blocks_of_capacity(rows, centres, capacity, nearest)


def kmeans_centres(rows: DataFrame, k: int, seed: int = 42) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector("v").alias("features"))
    return np.array(KMeans(k=k, seed=seed, maxIter=20, initMode="random").fit(data).clusterCenters())


@dataclass(frozen=True)
class LayoutConfig:
    capacity: int = 16
    k: int = 3
    t: float = 0.3
    nearest: int = 5
    seed: int = 42
    use_queries: bool = True


def query_layout(base: DataFrame, queries: DataFrame, dims: int, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """(vec_id, cid, pos): the query-attracted layout.

    Vectors are mapped by the queries' covariance, pulled to the queries, normalised, put into blocks of at most
    `capacity`, blocks ordered by their attraction to the mean query direction, members by distance to the centre.
    """
    from pageloom.operators import orders

    a = adaptive_matrix(stats.covariance_matrix(queries.select(F.col("q").alias("v")), "v", dims))
    mapped_queries = linear(queries, "q", a, "query_id")
    x = linear(base, "v", a, "vec_id")
    anchors = query_anchors(mapped_queries) if config.use_queries else base_anchors(x)
    x = gravity(x, "v", anchors, config.k, config.t, own=not config.use_queries)
    x = x.select("vec_id", V.normalise(F.col("v")).alias("v"))
    n = base.count()
    blocks = max(1, -(-n // config.capacity))
    centres = kmeans_centres(x, blocks, config.seed) if blocks > 1 else np.zeros((1, dims))
    labels = assign_blocks(x, centres, config.capacity, config.nearest)
    placed = x.join(labels, "vec_id")
    means = stats.mean_vector(placed, "v", "cid").withColumnRenamed("mean", "c")
    rows = placed.join(F.broadcast(means), "cid").withColumn("dist", V.l2(F.col("v"), F.col("c")))
    qbar = stats.mean_direction(mapped_queries)
    return orders.by_clusters(rows, orders.block_scores(rows, qbar), "score", F.col("dist"))


def morton_binary(grid: np.ndarray, bits: int) -> list[bytes]:
    """Z-order keys of any width: bit b of dimension d at place b * dims + d, big-endian bytes that sort like numbers."""
    n, dims = grid.shape
    planes = (grid[:, None, ::-1] >> np.arange(bits - 1, -1, -1)[None, :, None]) & 1
    flat = planes.reshape(n, bits * dims).astype(np.uint8)
    pad = -flat.shape[1] % 8
    return [r.tobytes() for r in np.packbits(np.pad(flat, ((0, 0), (pad, 0))), axis=1)]


def hilbert_binary(grid: np.ndarray, bits: int) -> list[bytes]:
    """Hilbert keys of integer points (the transpose method), as big-endian bytes."""
    x = grid.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q).astype(bool)
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(up, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q).astype(bool), t ^ (q - 1), t)
        q >>= 1
    x ^= t
    planes = (x.T[:, None, :] >> np.arange(bits - 1, -1, -1)[None, :, None]) & 1
    flat = planes.reshape(grid.shape[0], bits * dims).astype(np.uint8)
    return [r.tobytes() for r in np.packbits(np.pad(flat, ((0, 0), (-flat.shape[1] % 8, 0))), axis=1)]


def curve_order(base: DataFrame, bits: int, curve: str = "hilbert") -> DataFrame:
    """(vec_id, key, pos) along a space-filling curve over all dimensions; keys are bytes of any width."""
    from pyspark.sql import Window

    ends = stats.minmax(base)
    lo, hi = (np.array(x) for x in ends.first())
    make = hilbert_binary if curve == "hilbert" else morton_binary

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            grid = np.floor((x - lo) / (hi - lo + 1e-12) * ((1 << bits) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(make(grid, bits), pa.binary())], ["vec_id", "key"])

    keyed = base.select("vec_id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, key binary")
    # the key's first byte cuts the order into at most 256 ranges
    part = F.conv(F.substring(F.hex("key"), 1, 2), 16, 10).cast("int")
    ranged = keyed.withColumn("_part", part)
    counts = ranged.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy("key", "vec_id")
    return ranged.withColumn("_rank", F.row_number().over(inside) - 1).join(F.broadcast(starts), "_part").select("vec_id", "key", (F.col("_start") + F.col("_rank")).cast("long").alias("pos"))
