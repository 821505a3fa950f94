"""Windows over the query stream, hot vectors, representatives and samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import vectors as V
from pageloom.operators import blocks, knn


def windows(queries: DataFrame, size: int, label: str = "window") -> DataFrame:
    """(window_id, start_query_id, end_query_id, workload_label, query_count): `size` arrivals a window."""
    if size < 1:
        raise ValueError("a window holds at least one query")
    w = F.floor(F.col("query_id") / size).cast("long")
    rows = queries.groupBy(w.alias("window_id")).agg(F.min("query_id").alias("start_query_id"), F.max("query_id").alias("end_query_id"), F.count("*").alias("query_count"))
    return rows.withColumn("workload_label", F.concat(F.lit(f"{label}_"), F.col("window_id").cast("string")))


def with_window(queries: DataFrame, size: int) -> DataFrame:
    return queries.withColumn("window_id", F.floor(F.col("query_id") / size).cast("long"))


def hot_vectors(queries: DataFrame, base: DataFrame, size: int, neighbours: int, top: int, by_id: bool = False) -> DataFrame:
    """(window_id, rank, vec_id, score): vectors by the sum of 1 / rank over the window's neighbour lists.

    Ranks follow distance; by_id gives the order of the ids among each query's neighbours instead.
    """
    near = with_window(knn.exact(queries, base, neighbours), size)
    if by_id:
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id")))
    votes = near.groupBy("window_id", "vec_id").agg(F.round(F.sum(1.0 / F.col("rank")), 9).alias("score"))
    order = Window.partitionBy("window_id").orderBy(F.desc("score"), "vec_id")
    return votes.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("window_id", "rank", "vec_id", "score")


def hot_overlap(hot: DataFrame) -> DataFrame:
    """(window_id, hot_count, overlap): how many hot vectors the window before had as well (a window has at most `top`)."""
    sets = hot.groupBy("window_id").agg(F.collect_set("vec_id").alias("s"))
    before = F.lag("s").over(Window.orderBy("window_id"))  # a row a window
    return sets.select("window_id", F.size("s").cast("long").alias("hot_count"), F.coalesce(F.size(F.array_intersect("s", before)), F.lit(0)).cast("long").alias("overlap"))


def representatives(queries: DataFrame, size: int) -> DataFrame:
    """(window_id, query_id, density, q): the densest query of each window under a Gaussian kernel.

    One bandwidth a window: the population standard deviation of all its values, at least 1e-6. A query counts
    towards itself; ties go to the smaller id.
    """
    rows = with_window(queries, size)
    flat = rows.select("window_id", F.explode("q").alias("x")).groupBy("window_id").agg(F.greatest(F.stddev_pop("x"), F.lit(1e-6)).alias("h"))
    a, b = rows.alias("a"), rows.select("window_id", F.col("q").alias("q2")).alias("b")
    pairs = a.join(b, "window_id").join(F.broadcast(flat), "window_id")
    d = F.sum(F.exp(-V.squared_l2(F.col("q"), F.col("q2")) / (2 * F.col("h") * F.col("h"))))
    scored = pairs.groupBy("window_id", "query_id").agg(F.round(d, 9).alias("density"))
    best = scored.groupBy("window_id").agg(F.max(F.struct("density", (-F.col("query_id")).alias("neg"))).alias("m"))
    chosen = best.select("window_id", (-F.col("m.neg")).alias("query_id"), F.col("m.density").alias("density"))
    return chosen.join(rows.select("query_id", "q"), "query_id").select("window_id", "query_id", "density", "q")


def kde_scores(queries: DataFrame, base: DataFrame) -> DataFrame:
    """(query_id, score): the sum over dimensions of the base data's kernel density at the query (Scott's rule).

    Queries go to the tasks in slices of a checked size; a task sends one sum a query.
    """
    long = base.select(F.posexplode("v").alias("i", "x"))
    spread = long.groupBy("i").agg((F.stddev_samp("x") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("h"), F.count("*").alias("n")).orderBy("i").collect()  # a row a dimension
    h, n = np.array([r["h"] for r in spread]), max((r["n"] for r in spread), default=0)
    parts = max(1, -(-blocks.size_of(queries, "q")[1] // blocks.SHARED_BYTES))
    out = None
    for part in range(parts):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        shared = base.sparkSession.sparkContext.broadcast((*blocks.held(mine, "query_id", "q"), h))

        def run(batches, shared=shared):
            keys, q, h = shared.value
            total = np.zeros(len(keys))
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    v = blocks.matrix(batch.column(0).slice(at, 256)) / h
                    for i in range(len(keys)):
                        total[i] += (np.exp(-0.5 * (q[i] / h - v) ** 2) / h).sum()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], ["query_id", "score"])

        one = base.select(F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "query_id long, score double")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("query_id").agg((F.sum("score") / (n * (2.0 * 3.141592653589793) ** 0.5 if n else 1.0)).alias("score"))


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone, by arithmetic that every engine shares."""
    return ((id_col * 2654435761 + seed * 40503) % 1000003 + 1) / 1000005.0


def biased_sample(rows: DataFrame, id_col: str, n: int, weight: Column, seed: int = 0) -> DataFrame:
    """n rows without replacement, by weight: the smallest -ln(u) / weight win."""
    key = F.round(-F.log(uniform(F.col(id_col), seed)) / weight, 9)
    return rows.withColumn("_key", key).orderBy("_key", id_col).limit(n).drop("_key")


def last_rows(rows: DataFrame, order: str, w: int, *keys: str) -> DataFrame:
    """The last w rows of each group (of the whole table without keys)."""
    if not keys:
        return rows.orderBy(F.desc(order)).limit(w)
    recent = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(recent)).where(F.col("_n") <= w).drop("_n")


def uniform_sample(rows: DataFrame, id_col: str, n: int, by: str, seed: int = 0) -> DataFrame:
    """n rows of each group, by a hash of the id; their order is left to the id."""
    w = Window.partitionBy(by).orderBy(uniform(F.col(id_col), seed), id_col)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def clustered_stream(rows: DataFrame, by: str, rounds: int, size: int, noise: float, seed: int) -> DataFrame:
    """(query_id, by, vec_id, q): rounds of `size` queries, each round from one cluster: its members, moved in every
    dimension by at most `noise` of that dimension's standard deviation. Clusters, members and noise are drawn by hashes."""
    long = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.stddev_samp("x").alias("s"))
    spread = long.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda s: s.s).alias("spread"))  # a row a dimension
    groups = rows.groupBy(by).agg(F.count("*").alias("n"))  # a row a cluster
    groups = groups.withColumn("p", F.row_number().over(Window.orderBy(by)) - 1).withColumn("k", F.count("*").over(Window.partitionBy()))
    turns = rows.sparkSession.range(rounds).withColumnRenamed("id", "t")
    chosen = turns.join(F.broadcast(groups), F.floor(uniform(F.col("t"), seed) * F.col("k")) == F.col("p"))
    drawn = chosen.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("query_id", (F.col("t") * size + F.col("j")).cast("long"))
    drawn = drawn.select("query_id", by, F.floor(uniform(F.col("query_id"), seed + 1) * F.col("n")).alias("place"))
    members = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("vec_id")) - 1)
    met = members.join(F.broadcast(drawn), [by, "place"]).crossJoin(F.broadcast(spread))  # rounds * size rows
    dims = F.size("v")
    moved = F.transform("v", lambda x, i: x + noise * F.get(F.col("spread"), i) * (2 * uniform(F.col("query_id") * dims + i, seed + 2) - 1))
    return met.select("query_id", by, "vec_id", moved.alias("q"))


def markov_templates(spark, templates: int, length: int, stay: float, seed: int) -> DataFrame:
    """(query_id, template): a walk over query templates that stays with probability `stay`, else moves to another one.

    A walk is one sequence; its steps come from a hash of the place, so the same seed gives the same walk.
    """

    def u(i: int, s: int) -> float:
        return ((i * 2654435761 + s * 40503) % 1000003 + 1) / 1000005.0

    at, rows = 0, []
    for i in range(length):
        if i and u(i, seed) >= stay:
            at = (at + 1 + int(u(i, seed + 1) * (templates - 1))) % templates
        rows.append((i, at))
    return spark.createDataFrame(rows, "query_id long, template long")


def random_ranges(rows: DataFrame, column: str, n: int, selectivity: float, seed: int) -> DataFrame:
    """(query_id, lo, hi): ranges of a share of the column's span, drawn anywhere inside it."""
    ends = rows.agg(F.min(column).alias("lo0"), F.max(column).alias("hi0"))
    drawn = rows.sparkSession.range(n).withColumnRenamed("id", "query_id").crossJoin(F.broadcast(ends))
    span = F.col("hi0") - F.col("lo0")
    lo = F.col("lo0") + uniform(F.col("query_id"), seed) * span * (1 - selectivity)
    return drawn.select("query_id", lo.alias("lo"), (lo + span * selectivity).alias("hi"))


def random_sets(rows: DataFrame, column: str, n: int, k: int, seed: int) -> DataFrame:
    """(query_id, values): k different values of a category, drawn for each of n queries. Categories' values are few."""
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    place = values.withColumn("p", F.row_number().over(Window.orderBy("value")) - 1)
    drawn = rows.sparkSession.range(n).withColumnRenamed("id", "query_id").crossJoin(F.broadcast(place))
    order = Window.partitionBy("query_id").orderBy(uniform(F.col("query_id") * 1000 + F.col("p"), seed), "p")
    chosen = drawn.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return chosen.groupBy("query_id").agg(F.array_sort(F.collect_list("value")).alias("values"))


def random_spans(rows: DataFrame, column: str, n: int, days: int, seed: int) -> DataFrame:
    """(query_id, lo, hi): spans of so many days that begin on a day between the column's first and last."""
    ends = rows.agg(F.min(F.to_date(column)).alias("a"), F.max(F.to_date(column)).alias("b"))
    drawn = rows.sparkSession.range(n).withColumnRenamed("id", "query_id").crossJoin(F.broadcast(ends))
    lo = F.date_add("a", F.floor(uniform(F.col("query_id"), seed) * (F.datediff("b", "a") + 1)).cast("int"))
    return drawn.select("query_id", lo.alias("lo"), F.date_add(lo, days).alias("hi"))


def filled_templates(walk: DataFrame, ranges: DataFrame, n: int) -> DataFrame:
    """(query_id, template, lo, hi): each query of a walk takes one of the n ranges, by its place and template."""
    picked = walk.withColumn("pick", (F.col("query_id") * 7 + F.col("template")) % n)
    return picked.join(F.broadcast(ranges.withColumnRenamed("query_id", "pick")), "pick").select("query_id", "template", "lo", "hi")


def resampled_rows(rows: DataFrame, dims: tuple[int, int], n: int, seed: int) -> DataFrame:
    """(row_id, v): n rows that are the mean in all dimensions but two, which come from drawn vectors."""
    from pageloom.operators import stats

    total = rows.count()
    placed = rows.select("v", F.col("vec_id"))
    draws = rows.sparkSession.range(n).withColumnRenamed("id", "row_id").withColumn("vec_id", F.floor(uniform(F.col("row_id"), seed) * total).cast("long"))
    met = draws.join(placed, "vec_id").crossJoin(F.broadcast(stats.mean_vector(rows, "v")))
    return met.select("row_id", F.transform("mean", lambda m, i: F.when(i.isin(list(dims)), F.get("v", i)).otherwise(m)).alias("v"))


def sampled_files(rows: DataFrame, file: str, key: str, least: int, share: float, seed: int) -> DataFrame:
    """Of each file min(max(least, share * rows), rows) rows, by a hash of the key: the sample that a plan is made from."""
    sizes = rows.groupBy(file).agg(F.count("*").alias("_n"))  # a row a file
    want = F.least(F.greatest(F.lit(least), F.floor(F.col("_n") * share)), F.col("_n"))
    order = Window.partitionBy(file).orderBy(uniform(F.col(key), seed), key)
    met = rows.join(F.broadcast(sizes.withColumn("_want", want)), file)
    return met.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("_want")).drop("_n", "_want", "_r")


def neighbour_samples(queries: DataFrame, base: DataFrame, ks: list[int], seed: int) -> DataFrame:
    """(query_id, k, vec_id): each query with as many neighbours as one of the ks, drawn by its id."""
    choice = F.floor(uniform(F.col("query_id"), seed) * len(ks)).cast("int")
    near = knn.exact(queries, base, max(ks)).withColumn("k", F.get(F.array(*[F.lit(k) for k in ks]), choice))
    return near.where(F.col("rank") <= F.col("k")).select("query_id", "k", "vec_id")


def running_costs(costs: DataFrame) -> DataFrame:
    """costs with total: each state's costs up to and with the window."""
    upto = Window.partitionBy("state").orderBy("window_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return costs.withColumn("total", F.sum("cost").over(upto))
