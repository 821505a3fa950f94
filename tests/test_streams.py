"""Streams whose results are tables of any size."""

import datetime as dt

from pageloom import registry
from pageloom.streaming import windows as S

ROOT = "/root/testdata/sf0.001"


def test_sessions_stay_off_the_driver(spark):
    found = registry.queries()["stream_sessions"](spark, ROOT)
    assert found.inputFiles()  # a stored table; a memory sink has none


def test_sessions_over_several_batches(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(u, day + dt.timedelta(minutes=m)) for u, m in ((1, 0), (1, 10), (1, 39), (1, 70), (2, 0), (2, 100))]
    for name, some in (("a", rows[::2]), ("b", rows[1::2])):
        spark.createDataFrame(some, "user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / name))
        (part,) = (tmp_path / name).glob("part-*.parquet")
        part.rename(tmp_path / name / "events.parquet")
    schema = spark.read.parquet(str(tmp_path / "a")).schema
    found = S.drained_table(S.sessions(S.event_stream(spark, str(tmp_path), schema), "30 minutes", "1 day"), "test")
    assert sorted((r["user_id"], r["n"]) for r in found.collect()) == [(1, 1), (1, 3), (2, 1), (2, 1)]


def test_a_stream_without_rows(spark, tmp_path):
    (tmp_path / "none").mkdir()
    schema = spark.read.parquet(f"{ROOT}/events.parquet").schema
    assert S.drained_table(S.sessions(S.event_stream(spark, str(tmp_path / "none"), schema)), "test").count() == 0
