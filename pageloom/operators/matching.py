"""Vectors to centres with room for so many: the result of a sequential greedy, found in rounds.

Every vector applies to its best centre that has not ruled it out, and a centre with more applicants than room keeps the
first ones by (d, vec_id) and rules out all after its last. If d is the distance, the outcome is that of taking all pairs
of vector and centre by distance; if d is a vector's place in an order, that of one vector after the other choosing.
Bounds, one a centre, are all that comes to the driver and goes to the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.operators import blocks
from pageloom.operators.ranking import ranked
from pageloom.sources.scratch import stored

Bounds = tuple[np.ndarray, np.ndarray]
APPLIED = "vec_id long, at int, d double"


def _first_admitted(ids: np.ndarray, p: np.ndarray, d: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """The first choice of each row whose bound it does not pass, and its d; -1 without one."""
    last, last_id = bounds
    good = (d < last[p]) | ((d == last[p]) & (ids[:, None] <= last_id[p]))
    first = good.argmax(1)
    rows = np.arange(len(ids))
    return np.where(good.any(1), p[rows, first], -1), d[rows, first]


def settled(apply_to: Callable[[object], DataFrame], room: np.ndarray, spark, many: bool) -> DataFrame:
    """(vec_id, at, d): each vector's centre once no centre has more applicants than room; at is -1 where all ruled it out.

    apply_to gives the applications under broadcast bounds; many says that centres are many and each has few applicants.
    """
    last = np.where(room > 0, np.inf, -np.inf)
    last_id = np.full(len(room), np.iinfo(np.int64).max)
    while True:
        applied = apply_to(spark.sparkContext.broadcast((last.copy(), last_id.copy())))
        at = applied.where("at >= 0")
        if many:
            placed = at.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy("d", "vec_id")) - 1)
        else:
            placed = ranked(at, "d", "vec_id", ("at",))
        sizes = spark.createDataFrame([(i, int(r)) for i, r in enumerate(room.tolist())], "at int, room long")
        met = placed.join(F.broadcast(sizes), "at")  # a row a centre
        kept = F.max(F.when(F.col("rank") < F.col("room"), F.struct("d", "vec_id")))
        over = met.groupBy("at").agg(F.count("*").alias("n"), F.first("room").alias("room"), kept.alias("last")).where("n > room").collect()
        if not over:
            return applied
        for r in over:
            last[r["at"]], last_id[r["at"]] = r["last"]["d"], r["last"]["vec_id"]


def by_preferences(prefs: DataFrame, room: np.ndarray, many: bool) -> DataFrame:
    """settled() for (vec_id, p, d): each vector's choices, best first, and its place with each; all lists have one length."""

    def apply_to(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                if len(ids):
                    p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                    at, d = _first_admitted(ids, p, blocks.matrix(batch.column(2)), shared.value)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(d)], ["vec_id", "at", "d"])

        return prefs.select("vec_id", "p", "d").mapInArrow(run, APPLIED)

    return settled(apply_to, room, prefs.sparkSession, many)


def nearest_choices(rows: DataFrame, centres: np.ndarray, s: int) -> DataFrame:
    """(vec_id, p, d): the s nearest centres of each vector by (distance at nine decimals, place)."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                d = np.round(blocks.distances(blocks.matrix(part.column(1)), shared.value), 9)
                near = np.argsort(d, axis=1, kind="stable")[:, :s].astype(np.int32)
                ends = pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1])
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (near, np.take_along_axis(d, near, 1))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["vec_id", "p", "d"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, p array<int>, d array<double>")


def blocks_of_capacity(rows: DataFrame, centres: np.ndarray, capacity: int, nearest: int) -> DataFrame:
    """(vec_id, cid): pairs of vector and centre taken by distance under a capacity, first among each vector's `nearest`
    centres; vectors that are left go by distance to whatever centre still has room."""
    spark, room = rows.sparkSession, np.full(len(centres), capacity)
    first = stored(by_preferences(stored(nearest_choices(rows, centres, min(nearest, len(centres))), "choices"), room, many=True), "blocks")
    placed = first.where("at >= 0").select("vec_id", F.col("at").alias("cid"))
    taken = {r["cid"]: r["count"] for r in placed.groupBy("cid").count().collect()}  # a row a centre
    free = room - np.array([taken.get(i, 0) for i in range(len(centres))])
    left = stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).join(first.where("at < 0").select("vec_id"), "vec_id"), "left")
    if left.isEmpty():
        return placed
    open_now = np.flatnonzero(free > 0)
    held = spark.sparkContext.broadcast(centres[open_now])

    def apply_to(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, last_id = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    d = np.round(blocks.distances(blocks.matrix(part.column(1)), held.value), 9)
                    d = np.where((d < last) | ((d == last) & (ids[:, None] <= last_id)), d, np.inf)
                    best = d.argmin(1)
                    value = d[np.arange(len(ids)), best]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(np.isinf(value), -1, best).astype(np.int32)), pa.array(value)], ["vec_id", "at", "d"])

        return left.mapInArrow(run, APPLIED)

    found = settled(apply_to, free[open_now], spark, many=True)
    names = spark.createDataFrame([(i, int(c)) for i, c in enumerate(open_now.tolist())], "at int, cid int")
    return placed.unionByName(found.join(F.broadcast(names), "at").select("vec_id", "cid"))
