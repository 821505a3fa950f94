"""Aggregates over vectors; all are partial on the map side and return a few rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import vectors as V


def mean_vector(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """(keys, mean): the mean of each dimension, by group."""
    long = rows.select(*keys, F.posexplode(vector).alias("i", "x"))
    means = long.groupBy(*keys, "i").agg(F.avg("x").alias("m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("mean"))


def centroids(rows: DataFrame, vector: str = "v", by: str = "label") -> DataFrame:
    """(cid, c): group means as cluster centres."""
    return mean_vector(rows, vector, by).select(F.col(by).alias("cid"), F.col("mean").alias("c"))


def mean_direction(queries: DataFrame, vector: str = "q") -> DataFrame:
    """One row: the normalised mean of the queries."""
    return mean_vector(queries, vector).select(V.normalise(F.col("mean")).alias("qbar"))


def dispersion(queries: DataFrame, vector: str = "q", *keys: str) -> DataFrame:
    """(keys, dispersion): mean distance of the queries to their mean."""
    means = mean_vector(queries, vector, *keys)
    joined = queries.join(F.broadcast(means), list(keys)) if keys else queries.crossJoin(F.broadcast(means))
    return joined.groupBy(*keys).agg(F.avg(V.l2(F.col(vector), F.col("mean"))).alias("dispersion"))


def _moments(rows: DataFrame, vector: str, dims: int):
    """n, sums and the Gram matrix, summed inside each partition in NumPy; one row a partition is sent."""

    def run(batches):
        import pyarrow as pa

        n, total, gram = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(-1, dims)
            n, total, gram = n + len(x), total + x.sum(0), gram + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([gram.ravel().tolist()])], ["n", "s", "g"])

    return rows.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null").mapInArrow(run, "n long, s array<double>, g array<double>")


def covariance_matrix(rows: DataFrame, vector: str, dims: int, clamp: bool = True) -> np.ndarray:
    """The sample covariance (n - 1) as a dims x dims array on the driver."""
    parts = _moments(rows, vector, dims)
    n = sums = gram = 0
    # dims * dims numbers a partition
    for r in parts.toLocalIterator():
        n, sums, gram = n + r["n"], sums + np.array(r["s"]), gram + np.array(r["g"]).reshape(dims, dims)
    if not n:
        raise ValueError("no vectors")
    return (gram - np.outer(sums, sums) / n) / max(1, n - 1)


def covariance(rows: DataFrame, vector: str = "v") -> DataFrame:
    """(i, j, cov) for i <= j, in DataFrame operations: pairs of dimensions inside each row, then one aggregate."""
    pairs = F.expr(f"flatten(transform({vector}, (x, i) -> transform(slice({vector}, i + 1, size({vector})), (y, j) -> named_struct('i', i, 'j', i + j, 'x', x, 'y', y))))")
    p = rows.select(F.explode(pairs).alias("p")).select("p.*")
    return p.groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"))


def minmax(rows: DataFrame, vector: str = "v") -> DataFrame:
    """One row: the smallest and largest value of each dimension."""
    long = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    packed = F.array_sort(F.collect_list(F.struct("i", "lo", "hi")))
    return long.agg(packed.alias("b")).select(F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))


def histogram_cdf(rows: DataFrame, value: str, max_bins: int = 32) -> DataFrame:
    """(x, y): right bin edges and the share of values up to them; ceil(sqrt(n)) bins, at most max_bins.

    Equal minima and maxima are widened by a half on both sides; the last bin is closed.
    """
    ends = rows.agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    ends = ends.select("n", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    ends = ends.withColumn("bins", F.greatest(F.lit(1), F.least(F.lit(max_bins), F.ceil(F.sqrt("n")).cast("int"))))
    binned = rows.select(F.col(value).alias("x")).crossJoin(F.broadcast(ends))
    index = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")).cast("int"), F.col("bins") - 1)
    counts = binned.groupBy(index.alias("bin")).count()
    edges = ends.select("n", "lo", "hi", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    from pyspark.sql import Window

    upto = F.sum(F.coalesce("count", F.lit(0))).over(Window.orderBy("bin"))  # at most max_bins rows
    return edges.join(counts, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / F.col("bins")).alias("x"), (upto / F.col("n")).alias("y"))


def merge_runs(rows: DataFrame, order: str, value: str, *keys: str, ranges: int = 64) -> DataFrame:
    """(keys, run, value, first, last, n): consecutive rows of equal value as one run, in the given order.

    Keys partition the order. Without keys the whole table is one sequence: it is cut into ranges of a numeric order, and
    a range learns from the ranges before it how many runs they began and which value came last.
    """
    from pyspark.sql import Window

    part = F.lit(0)
    if not keys:
        shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
        cuts = rows.agg(F.array_distinct(F.percentile_approx(order, shares, F.lit(10000))).alias("_cuts"))
        rows = rows.crossJoin(F.broadcast(cuts))
        part = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    rows = rows.withColumn("_part", part).drop("_cuts")
    w = Window.partitionBy(*keys, "_part").orderBy(order)
    before = F.lag(value).over(w)
    new = (~F.col(value).eqNullSafe(before) | F.lag(order).over(w).isNull()).cast("int")
    marked = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    if not keys:
        # a row a range: its runs, its first and last value
        ends = marked.groupBy("_part").agg(F.max("run").alias("_runs"), F.min_by(value, order).alias("_head"), F.max_by(value, order).alias("_tail"))
        line = Window.orderBy("_part")
        joined = (F.lag("_runs").over(line).isNotNull() & F.col("_head").eqNullSafe(F.lag("_tail").over(line))).cast("int")
        ends = ends.withColumn("_joined", joined)
        shift = F.sum(F.col("_runs") - F.col("_joined")).over(line) - F.col("_runs")
        marked = marked.join(F.broadcast(ends.select("_part", shift.alias("_shift"))), "_part").withColumn("run", F.col("run") + F.col("_shift"))
    return marked.groupBy(*keys, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def mean_distance(a: DataFrame, b: DataFrame, on: list[str], value: str) -> Column:
    """Mean absolute difference of two cost profiles: one row, `distance`."""
    joined = a.select(*on, F.col(value).alias("x")).join(b.select(*on, F.col(value).alias("y")), on)
    return joined.agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("distance"))


def disagreement(a: DataFrame, b: DataFrame, on: str, label: str) -> DataFrame:
    """The share of rows whose labels differ: one row, `disagreement`."""
    joined = a.select(on, F.col(label).alias("x")).join(b.select(on, F.col(label).alias("y")), on)
    return joined.agg((1 - F.count_if(F.col("x") == F.col("y")) / F.count("*")).alias("disagreement"))
