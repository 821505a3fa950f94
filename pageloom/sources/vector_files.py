"""Vector files: fvecs, ivecs, xbin, npy and CSV, read in parallel where the format has fixed-size records."""

from __future__ import annotations

import ast
import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_XBIN = {"fbin": "<f4", "u8bin": "u1", "i8bin": "i1", "ibin": "<i4"}


def read_vecs(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(vec_id, embedding) of .fvecs (floats) or .ivecs (ints): each record is its length and that many values.

    Records have one size, so the file is split anywhere between them. strict checks every record's own length.
    """
    sc = spark.sparkContext
    head = sc.binaryRecords(path, 4).take(1)
    if not head:
        raise ValueError(f"{path} is empty")
    dims = struct.unpack("<i", head[0])[0]
    if dims < 1:
        raise ValueError(f"{path} starts with length {dims}")
    kind, name = ("<i4", "int") if path.rstrip("/").endswith(".ivecs") else ("<f4", "float")

    def parse(pair):
        raw, i = pair
        if strict and struct.unpack_from("<i", raw)[0] != dims:
            raise ValueError(f"record {i} does not have {dims} values")
        return i, np.frombuffer(raw, kind, dims, 4).tolist()

    records = sc.binaryRecords(path, 4 * (dims + 1)).zipWithIndex()
    return spark.createDataFrame(records.map(parse), f"vec_id long, embedding array<{name}>")


def _head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first bytes of a file in any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(stream.read() & 255 for _ in range(n))
    finally:
        stream.close()


def _sliced(spark: SparkSession, path: str, offset: int, n: int, dims: int, kind: str) -> DataFrame:
    """(vec_id, embedding) of n rows of fixed size that begin at an offset: slices of a thousand rows, each read by a task of its own."""
    width = dims * np.dtype(kind).itemsize
    name = "int" if kind == "<i4" else "float"
    if "://" in path and not path.startswith("file://"):
        # not on the workers' disks: fixed-size records of the whole file, cut anew
        content = spark.read.format("binaryFile").load(path).select("content")

        def cut(batches):
            for batch in batches:
                for raw in batch.column(0):
                    x = np.frombuffer(raw.as_py(), kind, n * dims, offset).reshape(n, dims)
                    yield from _rows_of(x, 0, name)

        return content.mapInArrow(cut, f"vec_id long, embedding array<{name}>")
    local = path.removeprefix("file://")

    def run(batches):
        for batch in batches:
            for first in batch.column(0).to_pylist():
                many = min(1000, n - first)
                with open(local, "rb") as file:
                    file.seek(offset + first * width)
                    x = np.frombuffer(file.read(many * width), kind).reshape(many, dims)
                yield from _rows_of(x, first, name)

    starts = spark.range(0, n, 1000, max(1, min(-(-n // 1000), 8 * spark.sparkContext.defaultParallelism)))
    return starts.mapInArrow(run, f"vec_id long, embedding array<{name}>")


def _rows_of(x: np.ndarray, first: int, name: str):
    flat = pa.array(np.ascontiguousarray(x, "<i4" if name == "int" else "<f4").ravel())
    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(x))), pa.ListArray.from_arrays(ends, flat)], ["vec_id", "embedding"])


def read_xbin(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(vec_id, embedding) of .fbin, .u8bin, .i8bin or .ibin: count and length, then the values; `limit` rows if given."""
    n, dims = struct.unpack("<II", _head(spark, path, 8))
    return _sliced(spark, path, 8, min(n, limit) if limit is not None else n, dims, _XBIN[path.rsplit(".", 1)[-1]])


def read_csv_vectors(spark: SparkSession, path: str, header: bool = True, dims: int | None = None, sep: str = ",", glob: str | None = None, id_column: bool = True) -> DataFrame:
    """(vec_id, embedding) of CSV files, with the id first or without ids.

    With a header, vectors are the columns v0, v1, ... or all after the id, the first `dims` of them; other columns
    (score, is_selected, cluster_label) are kept by name. Without ids, or without a header, ids are row numbers from 0
    through all files, in the order of their names and lines. A row with another number of values is an error.
    """
    reader = spark.read.option("header", header).option("sep", sep).option("inferSchema", False).option("mode", "FAILFAST")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).csv(path)
    with_id = header and id_column
    if with_id and rows.columns[0] != "id":
        raise ValueError("the first column is not id")
    given = rows.columns[1:] if with_id else rows.columns
    named = [c for c in given if c[0] == "v" and c[1:].isdigit()] if header else []
    vector = sorted(named, key=lambda c: int(c[1:])) or given
    if dims is not None and len(vector) < dims:
        raise ValueError(f"there are {len(vector)} values a row, not {dims}")
    extra = [c for c in given if c not in vector] if header else []
    value = F.array(*[F.col(f"`{c}`").cast("float") for c in vector[:dims]]).alias("embedding")
    if with_id:
        return rows.select(F.col("id").cast("long").alias("vec_id"), value, *extra)
    # a row's place: its part, and its place there; the rows of the parts before it are counted
    placed = rows.select(value, *extra, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    counts = placed.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))  # a row a part of a file
    starts = counts.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    met = placed.join(F.broadcast(starts), ["file", "block"])
    return met.select((F.col("before") + F.col("place") - F.col("first")).alias("vec_id"), "embedding", *extra)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding) of a matrix in C order."""
    head = io.BytesIO(_head(spark, path, 12))
    version = np.lib.format.read_magic(head)
    size = struct.unpack("<H", head.read(2))[0] if version == (1, 0) else struct.unpack("<I", head.read(4))[0]
    begin = 8 + (2 if version == (1, 0) else 4)
    spec = ast.literal_eval(_head(spark, path, begin + size)[begin:].decode("latin1"))
    if len(spec["shape"]) != 2 or spec["fortran_order"]:
        raise ValueError("not a matrix in C order")
    return _sliced(spark, path, begin + size, *spec["shape"], spec["descr"])


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Any of the formats, by the file's ending."""
    ending = path.rstrip("/").rsplit(".", 1)[-1]
    if ending in ("fvecs", "ivecs"):
        return read_vecs(spark, path)
    if ending in _XBIN:
        return read_xbin(spark, path)
    if ending == "npy":
        return read_npy(spark, path)
    if ending == "csv":
        return read_csv_vectors(spark, path, header=False)
    raise ValueError(f"unknown vector file {path}")


def read_membership(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(posting_id, vec_id) of a posting file; ids lie in 0 .. n - 1, each in exactly one posting."""
    rows = spark.read.option("header", True).schema("posting_id int, vector_id long").csv(path).withColumnRenamed("vector_id", "vec_id").dropDuplicates()
    bad = rows.where(~F.col("vec_id").between(0, n - 1) | F.col("posting_id").isNull()).count()
    if bad:
        raise ValueError(f"{bad} memberships are out of range")
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        raise ValueError("a vector is in two postings")
    if rows.count() != n:
        raise ValueError("a vector is in no posting")
    return rows
