"""Helpers that several corpus operators need."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the 'plain' kind: runs of anything but ASCII white space. bytes.split() splits at the same six bytes.
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scopes: list[list[str]] = []


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a session in one process gets a folder of its own; any other is refused, as its executors
    would not see each other's files.
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or _own.get(spark.sparkContext.applicationId)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="pageloom-")
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def written(df: DataFrame, tag: str, narrow: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    narrow: rows are a few numbers, so they are dealt to an eighth of the usual files; what made them keeps its width.
    The table goes when dropped() is called, when the surrounding temporary() ends, or with the session.
    """
    spark = df.sparkSession
    if narrow:
        df = df.repartition(max(1, partitions(spark) // 8))
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing needs any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            delete(df.sparkSession, path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what written() has stored inside it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id's text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def released() -> None:
    """Gives memory that a Python worker has freed back to the system: workers outlive their tasks."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
