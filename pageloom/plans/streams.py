"""Streams over the events table, run over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pageloom.functions import vectors as V
from pageloom.sources.tables import table
from pageloom.streaming import windows as S


def _stream(spark, root):
    return S.event_stream(spark, root, table(spark, root, "events").schema)


def stream_tumbling(spark, root):
    rows = S.drained(S.tumbling(_stream(spark, root), "1 day"), f"t{uuid.uuid4().hex}", "complete")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", V.round6(F.col("total")).alias("total"))


def stream_reservoirs(spark, root):
    rows = S.reservoirs(_stream(spark, root), "user_id", "event_id", 8, 4)
    return S.drained(rows, f"r{uuid.uuid4().hex}", "update")


def stream_sessions(spark, root):
    rows = S.drained_table(S.sessions(_stream(spark, root), "6 hours"), "sessions")
    return rows.select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")], "n")


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sessions, stream_reservoirs)}
ORACLES = {
    "stream_sessions": "with l as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events), g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from l) "
    "select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval 6 hour, '%Y-%m-%d %H:%M:%S') as \"end\", count(*) as n from g group by user_id, s",
    "stream_tumbling": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 6) + 0.0 as total from events group by 1, 2",
}
