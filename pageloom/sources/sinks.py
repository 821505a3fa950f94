"""Writers: layouts as CSV, tables and binary artifacts, manifests, vector files."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_layout_csv(layout: DataFrame, base: DataFrame, path: str, dims: int, extra: Iterable[str] = (), one_file: bool = False) -> None:
    """id[, extra], v0, v1, ... in physical order; files follow the order of positions, or are one."""
    rows = layout.join(base, "vec_id").select("pos", F.col("vec_id").alias("id"), *extra, *[F.col("v")[i].alias(f"v{i}") for i in range(dims)])
    ordered = rows.coalesce(1).sortWithinPartitions("pos") if one_file else rows.repartitionByRange("pos").sortWithinPartitions("pos")
    ordered.drop("pos").write.mode("overwrite").option("header", True).csv(path)


def table_name(name: str) -> str:
    stem = os.path.splitext(os.path.basename(str(name)))[0].lower()
    plain = re.sub(r"[^a-z0-9_]+", "_", stem).strip("_")
    if not plain:
        raise ValueError("a layout's name has a letter or a digit")
    return f"layout_{plain}" if plain[0].isdigit() else plain


def table_family(name: str) -> dict[str, str]:
    base = table_name(name)
    return {"base": base, "ivfflat": f"{base}_ivfflat", "hnsw": f"{base}_hnsw"}


def save_family(layout: DataFrame, base: DataFrame, name: str, cells: DataFrame | None = None) -> dict[str, str]:
    """The layout as a catalog table in physical order and, with (vec_id, cid) cells, its probe table partitioned by cell.

    The third table of the family, of a graph index, is a copy in the same order: there is no graph index here.
    """
    family = table_family(name)
    rows = layout.join(base, "vec_id").select("vec_id", "v", F.col("pos").alias("num"))
    for name in (family["base"], family["hnsw"]):
        rows.repartitionByRange("num").sortWithinPartitions("num").write.mode("overwrite").saveAsTable(name)
    if cells is not None:
        rows.join(cells.select("vec_id", "cid"), "vec_id").repartition("cid").write.mode("overwrite").partitionBy("cid").saveAsTable(family["ivfflat"])
    return family


# --- binary artifacts: executors encode, the driver copies bytes from one part after the other ---------------------


class _Out:
    """A file on the driver, or in any file system that Spark knows."""

    def __init__(self, spark, path: str):
        self._file = self._stream = None
        if "://" in path and not path.startswith("file://"):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            self._stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
        else:
            path = path.removeprefix("file://")
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            self._file = open(path, "wb")

    def __enter__(self) -> _Out:
        return self

    def write(self, raw: bytes) -> None:
        (self._file or self._stream).write(bytearray(raw) if self._stream else raw)

    def __exit__(self, *_) -> None:
        (self._file or self._stream).close()


def _encoded(rows: DataFrame, order: list[str], encode: Callable[[pa.RecordBatch], bytes]) -> Iterator[bytes]:
    """The rows' bytes in the order of the columns: ranges of the first column are sorted and encoded by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(batch)], pa.binary())], ["raw"])

    dealt = rows.repartitionByRange(order[0]).sortWithinPartitions(*order)
    return (bytes(r["raw"]) for r in dealt.mapInArrow(run, "raw binary").toLocalIterator())


def _u32(column: str) -> Callable[[pa.RecordBatch], bytes]:
    return lambda batch: batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False).astype("<u4").tobytes()


def _lists(batch: pa.RecordBatch) -> bytes:
    """A count and the ids of each list."""
    return b"".join(struct.pack("<I", len(ids)) + np.asarray(ids, "<u4").tobytes() for ids in batch.column(1).to_pylist())


def _pages(layout: DataFrame) -> Iterator[bytes]:
    pages = layout.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "vec_id"))).alias("m"))  # a page has its capacity
    return _encoded(pages.select("page_id", F.col("m.vec_id").alias("ids")), ["page_id"], _lists)


def _inverse(layout: DataFrame) -> Iterator[bytes]:
    return _encoded(layout.select("vec_id", "page_id"), ["vec_id"], _u32("page_id"))


def _shape(layout: DataFrame) -> tuple[int, int]:
    r = layout.agg(F.count("*").alias("n"), (F.max("page_id") + 1).alias("p")).first()
    return r["n"], int(r["p"] or 0)


def _write(spark, path: str, *parts: bytes | Iterator[bytes]) -> None:
    with _Out(spark, path) as out:
        for part in parts:
            for raw in (part,) if isinstance(part, bytes) else part:
                out.write(raw)


def write_partition_bin(layout: DataFrame, path: str, capacity: int) -> None:
    """uint64 capacity, pages, vectors; a uint32 count and the ids of each page; each id's page."""
    n, pages = _shape(layout)
    _write(layout.sparkSession, path, struct.pack("<QQQ", capacity, pages, n), _pages(layout), _inverse(layout))


def write_id_map(layout: DataFrame, path: str) -> None:
    """int32 vectors and 1, then the old id at each position."""
    _write(layout.sparkSession, path, struct.pack("<ii", layout.count(), 1), _encoded(layout.select("pos", "vec_id"), ["pos"], _u32("vec_id")))


def write_page_groups(layout: DataFrame, path: str, capacity: int) -> None:
    """uint64 pages and capacity, each page with its length, uint64 vectors and each id's page."""
    n, pages = _shape(layout)
    _write(layout.sparkSession, path, struct.pack("<QQ", pages, capacity), _pages(layout), struct.pack("<Q", n), _inverse(layout))


def write_assignment(layout: DataFrame, path: str) -> None:
    """uint64 vectors and pages, then each id's page."""
    _write(layout.sparkSession, path, struct.pack("<QQ", *_shape(layout)), _inverse(layout))


def write_posting_order(postings: DataFrame, path: str) -> None:
    """uint64 postings, their ids in order, their scores as float64."""
    rows = postings.select("ord", "posting_id", "score")
    scores = _encoded(rows, ["ord"], lambda batch: batch.column(2).to_numpy(zero_copy_only=False).astype("<f8").tobytes())
    _write(postings.sparkSession, path, struct.pack("<Q", postings.count()), _encoded(rows, ["ord"], _u32("posting_id")), scores)


def write_vector_to_posting(members: DataFrame, path: str) -> None:
    """uint64 vectors, then each id's posting."""
    _write(members.sparkSession, path, struct.pack("<Q", members.count()), _encoded(members.select("vec_id", "posting_id"), ["vec_id"], _u32("posting_id")))


def posting_lists(postings: DataFrame, members: DataFrame, layout: DataFrame) -> DataFrame:
    """(ord, ids): the vectors of each posting by their positions, postings in their order; a posting's list is bounded by its index."""
    rows = members.join(layout.select("vec_id", "pos"), "vec_id").join(postings.select("posting_id", "ord"), "posting_id")
    grouped = rows.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("pos", "vec_id"))).alias("m"))
    return grouped.select("ord", F.col("m.vec_id").alias("ids"))


def write_posting_pages(lists: DataFrame, path: str, capacity: int | None = None) -> None:
    """The vector ids of each posting with their count, after uint64 postings and, where given, the capacity."""
    n = lists.count()
    head = struct.pack("<Q", n) if capacity is None else struct.pack("<QQ", n, capacity)
    _write(lists.sparkSession, path, head, _encoded(lists.select("ord", "ids"), ["ord"], _lists))


def write_manifest(layout: DataFrame, path: str, capacity: int, system: str, access: DataFrame | None = None, **names) -> dict:
    """A JSON summary: sizes, the first 32 ids in order, and the 32 highest positive access scores by (-score, id)."""
    n, pages = _shape(layout)
    head = [r["vec_id"] for r in layout.where("pos < 32").orderBy("pos").select("vec_id").collect()]
    top = [] if access is None else [[r["vec_id"], r["access_score"]] for r in access.where("access_score > 0").orderBy(F.desc("access_score"), "vec_id").limit(32).collect()]
    out = {"system": system, "num_vectors": n, "num_pages": pages, "page_capacity": capacity, "permutation_head": head, "top_access": top, **names}
    _write(layout.sparkSession, path, json.dumps(out, indent=2).encode())
    return out


def _vectors(rows: DataFrame, vector: str, kind: str, headed: bool) -> Iterator[bytes]:
    def encode(batch: pa.RecordBatch) -> bytes:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1)
        if not headed:
            return x.tobytes()
        head = np.full((len(x), 1), x.shape[1], "<i4")
        return np.hstack([head.view(np.uint8), np.ascontiguousarray(x).view(np.uint8)]).tobytes()

    return _encoded(rows.select("vec_id", vector), ["vec_id"], encode)


def write_vecs(rows: DataFrame, path: str, vector: str = "embedding", kind: str = "<f4") -> None:
    """fvecs (or ivecs with kind '<i4') in the order of vec_id: each vector's length and its values."""
    _write(rows.sparkSession, path, _vectors(rows, vector, kind, True))


def write_xbin(rows: DataFrame, path: str, vector: str = "embedding", kind: str = "<f4") -> None:
    """uint32 count and length, then the values in the order of vec_id."""
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    _write(rows.sparkSession, path, struct.pack("<II", shape["n"], shape["d"] or 0), _vectors(rows, vector, kind, False))


_WRITERS = {"partition": write_partition_bin, "page_groups": write_page_groups}


def write_layout(layout: DataFrame, folder: str, fmt: str, capacity: int) -> list[str]:
    """The artifacts of a layout with pages: `partition`, `page_groups` (with the id map) or `assignment`; and a manifest."""
    os.makedirs(folder, exist_ok=True)
    paths = [f"{folder}/{fmt}.bin"]
    if fmt in _WRITERS:
        _WRITERS[fmt](layout, paths[0], capacity)
    elif fmt == "assignment":
        write_assignment(layout, paths[0])
    else:
        raise ValueError(f"unknown format {fmt}")
    if fmt == "page_groups":
        paths.append(f"{folder}/id_map.bin")
        write_id_map(layout, paths[-1])
    paths.append(f"{folder}/manifest.json")
    write_manifest(layout, paths[-1], capacity, fmt)
    return paths
