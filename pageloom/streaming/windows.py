"""Streams: event-time windows with a watermark, the last queries of each key, decayed samples and online switching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators.policies import CounterState
from pageloom.sources.scratch import path_for


def event_stream(spark: SparkSession, folder: str, schema, glob: str = "events.parquet", files: int = 1) -> DataFrame:
    """The events table as a stream, ts as an instant so that it can carry a watermark."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of event-time windows; rows later than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of sessions: events less than a gap apart."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class DecayedReservoir:
    """A time-decayed reservoir of at most k items; weights shrink by 1 - batch / (2k) a batch.

    The sample's expected size is the decayed weight, up to k; a fraction is one partial item that is present
    with that probability.
    """

    def __init__(self, k: int, batch: int, seed: int = 0):
        self.k, self.decay = k, 1 - batch / (2 * k)
        self.rng = np.random.default_rng(seed)
        self.full: list = []
        self.partial = None
        self.weight = 0.0

    def insert(self, items: list) -> None:
        b = len(items)
        if self.weight < self.k:
            self._shrink(self.decay * self.weight)
            self.full += list(items)
            self.weight = self.decay * self.weight + b
            if self.weight > self.k:
                self._shrink(self.k)
        else:
            self.weight = self.decay * self.weight + b
            if self.weight >= self.k:
                exact = b * self.k / self.weight
                m = min(len(self.full), int(exact) + int(self.rng.random() < exact - int(exact)))
                slots = self.rng.choice(len(self.full), m, replace=False)
                new = self.rng.choice(b, m, replace=b < m)
                for s, i in zip(slots, new, strict=True):
                    self.full[s] = items[i]
            else:
                self._shrink(self.weight - b)
                self.full += list(items)

    def _shrink(self, size: float) -> None:
        """Down to an expected size: whole items leave at random, one may become partial."""
        have = len(self.full) + (0 if self.partial is None else self.weight - int(self.weight))
        if size >= have:
            return
        whole, rest = int(size), size - int(size)
        pool = self.full + ([self.partial] if self.partial is not None else [])
        order = self.rng.permutation(len(pool))
        self.full = [pool[i] for i in order[:whole]]
        self.partial = pool[order[whole]] if rest > 0 and len(pool) > whole else None

    def sample(self) -> list:
        part = min(self.weight, self.k) - int(min(self.weight, self.k))
        extra = [self.partial] if self.partial is not None and self.rng.random() < part else []
        return [*self.full, *extra]


def reservoirs(events: DataFrame, key: str, value: str, k: int, batch: int, seed: int = 0) -> DataFrame:
    """(key, size, sample) after each micro-batch: a decayed reservoir a key, its state kept by the stream."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(names, frames, state):
        r = DecayedReservoir(k, batch, seed)
        if state.exists:
            full, partial, weight, seen = state.get
            r.full, r.partial, r.weight = list(full), partial if partial >= 0 else None, weight
            r.rng = np.random.default_rng((seed, seen))
        else:
            seen = 0
        items = [v for f in frames for v in f[value].tolist()]
        r.insert(items)
        state.update((r.full, -1 if r.partial is None else r.partial, r.weight, seen + len(items)))
        yield pd.DataFrame({key: [names[0]], "size": [len(r.full)], "sample": [" ".join(map(str, sorted(r.full)))]})

    rows = events.select(key, value).groupBy(key)
    return rows.applyInPandasWithState(step, f"{key} long, size long, sample string", "full array<long>, partial long, weight double, seen long", "update", GroupStateTimeout.NoTimeout)


def counter_switches(costs: DataFrame, run: str, alpha: float, seed: int = 0) -> DataFrame:
    """(run, window_id, candidate_id, switched): the counter policy over a stream of (run, window_id, candidate_id, state, cost).

    A run's counters are its state; a window's candidates arrive in one micro-batch.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(names, frames, state):
        policy = CounterState(alpha, seed)
        done = 0
        if state.exists:
            keys, values, current, done = state.get
            policy.counter, policy.current = dict(zip(keys, values, strict=True)), current or None
            policy.seen = done
        out = []
        rows = pd.concat(list(frames)).sort_values(["window_id", "candidate_id"], kind="stable")
        for window, group in rows.groupby("window_id", sort=True):
            name, _, switched = policy.window(list(zip(group["candidate_id"], group["state"], group["cost"], strict=True)))
            out.append((names[0], window, name, switched))
            done += 1
        state.update((list(policy.counter), list(policy.counter.values()), policy.current or "", done))
        yield pd.DataFrame(out, columns=[run, "window_id", "candidate_id", "switched"])

    grouped = costs.select(run, "window_id", "candidate_id", "state", "cost").groupBy(run)
    return grouped.applyInPandasWithState(step, f"{run} long, window_id long, candidate_id string, switched boolean", "keys array<string>, sums array<double>, current string, done long", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the rows it put out, in memory: for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def drained_table(stream: DataFrame, tag: str) -> DataFrame:
    """Runs a stream in complete mode over what is there and returns the result as a table in the shared folder.

    Each batch replaces the table; its rows, like the stream's state, go from the executors to that folder and not to the driver.
    """
    spark = stream.sparkSession
    path = path_for(spark, tag)
    spark.createDataFrame([], stream.schema).write.parquet(path)  # what a stream without a row leaves

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    query = stream.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", path_for(spark, f"{tag}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
