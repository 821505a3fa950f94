"""Queries that write a file in one of the formats and read it back, or show its bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pageloom.functions import vectors as V
from pageloom.operators import orders, pages, workload
from pageloom.plans import predicates as PP
from pageloom.plans import workload as W
from pageloom.plans.sql import BASE, QUERIES_CTE
from pageloom.sources import records, sinks, vector_files
from pageloom.sources.scratch import path_for
from pageloom.sources.tables import base_vectors, query_stream, table

CAPACITY = 16


def _shown(rows):
    e = F.col("embedding")
    return rows.select("vec_id", F.size(e).cast("long").alias("n"), V.round6(F.get(e, F.lit(0)).cast("double")).alias("first"), V.round6(F.element_at(e, -1).cast("double")).alias("last"))


def _embeddings(spark, root):
    return table(spark, root, "embeddings").select("vec_id", "embedding")


def file_fvecs(spark, root):
    path = f"{path_for(spark, 'vecs')}/x.fvecs"
    sinks.write_vecs(_embeddings(spark, root), path)
    return _shown(vector_files.read_vecs(spark, path))


def file_ivecs(spark, root):
    path = f"{path_for(spark, 'vecs')}/x.ivecs"
    rows = table(spark, root, "embeddings").select("vec_id", F.array("label", F.col("vec_id"), F.col("vec_id") % 7).alias("embedding"))
    sinks.write_vecs(rows, path, kind="<i4")
    return _shown(vector_files.load_vectors(spark, path))


def file_fbin(spark, root):
    path = f"{path_for(spark, 'bin')}/x.fbin"
    sinks.write_xbin(_embeddings(spark, root), path)
    return _shown(vector_files.read_xbin(spark, path))


def file_fbin_cropped(spark, root):
    """The first hundred vectors of the file: a crop is what this reader option is for."""
    path = f"{path_for(spark, 'bin')}/x.fbin"
    sinks.write_xbin(_embeddings(spark, root), path)
    return _shown(vector_files.read_xbin(spark, path, limit=100))


def file_ibin(spark, root):
    path = f"{path_for(spark, 'bin')}/x.ibin"
    rows = table(spark, root, "embeddings").select("vec_id", F.array("label", F.col("vec_id") % 9).alias("embedding"))
    sinks.write_xbin(rows, path, kind="<i4")
    return _shown(vector_files.load_vectors(spark, path))


def file_u8bin(spark, root):
    path = f"{path_for(spark, 'bin')}/x.u8bin"
    rows = table(spark, root, "embeddings").select("vec_id", F.array("label", F.col("vec_id") % 200).alias("embedding"))
    sinks.write_xbin(rows, path, kind="u1")
    return _shown(vector_files.load_vectors(spark, path))


def file_layout_csv(spark, root):
    """id, score, values in the order of a layout."""
    path, base = path_for(spark, "csv"), base_vectors(spark, root)
    layout = orders.scattered_order(base).withColumn("score", F.col("pos") * 2)
    sinks.write_layout_csv(layout, base, path, 64, extra=["score"])
    rows = vector_files.read_csv_vectors(spark, path)
    return _shown(rows).join(rows.select("vec_id", F.col("score").cast("long").alias("score")), "vec_id")


def file_cluster_csv(spark, root):
    """id, cluster_label, values; the first six of them are read."""
    path, base = path_for(spark, "csv"), base_vectors(spark, root)
    layout = orders.scattered_order(base).join(base.select("vec_id", F.col("label").alias("cluster_label")), "vec_id")
    sinks.write_layout_csv(layout, base, path, 64, extra=["cluster_label"])
    rows = vector_files.read_csv_vectors(spark, path, dims=6)
    return _shown(rows).join(rows.select("vec_id", F.col("cluster_label").cast("long").alias("cluster_label")), "vec_id")


def file_plain_csv(spark, root):
    """Values without header and ids, in several files: ids are row numbers through all of them."""
    path, base = path_for(spark, "csv"), base_vectors(spark, root)
    rows = base.select("vec_id", *[F.col("v")[i].alias(f"c{i}") for i in range(8)])
    rows.repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id").drop("vec_id").write.csv(path)
    return _shown(vector_files.read_csv_vectors(spark, path, header=False, glob="*.csv"))


def file_query_csv(spark, root):
    """A header but no ids; the first values of each query."""
    path, queries = path_for(spark, "csv"), query_stream(spark, root)
    rows = queries.select("query_id", *[F.col("q")[i].alias(f"feature_{i + 1}") for i in range(8)])
    rows.repartitionByRange(2, "query_id").sortWithinPartitions("query_id").drop("query_id").write.option("header", True).csv(path)
    return _shown(vector_files.read_csv_vectors(spark, path, dims=6, id_column=False)).withColumnRenamed("vec_id", "query_id")


def file_membership(spark, root):
    path = path_for(spark, "postings")
    rows = table(spark, root, "embeddings").select(F.col("label").cast("int").alias("posting_id"), F.col("vec_id").alias("vector_id"))
    rows.unionByName(rows.where("vector_id % 5 = 0")).write.option("header", True).csv(path)
    return vector_files.read_membership(spark, path, rows.count())


def file_windows_json(spark, root):
    path = path_for(spark, "windows")
    records.write_rows(workload.windows(query_stream(spark, root), W.WINDOW), path)
    return records.read_rows(spark, path, records.WINDOWS)


def file_families_json(spark, root):
    path = path_for(spark, "families")
    records.write_families(W.layout_families_proxy(spark, root), path)
    return records.read_families(spark, path)


def file_predicates(spark, root):
    path = path_for(spark, "workload")
    records.write_predicates(spark, PP.WORKLOAD, path)
    found = records.read_predicates(spark, path)
    counts = table(spark, root, "lineitem").agg(*[F.count_if(p.rows()).alias(f"q{i}") for i, p in enumerate(found)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("query_id"), F.col(f"q{i}").alias("rows")) for i in range(len(found))])).alias("r")).select("r.*")


def file_window_queries(spark, root):
    path = path_for(spark, "queries")
    records.write_window_queries(workload.with_window(query_stream(spark, root), W.WINDOW), path)
    rows = spark.read.parquet(path)
    return rows.select("query_id", F.col("window_id").cast("long").alias("window_id"), V.round6(F.col("q")[0]).alias("x"))


def file_results_csv(spark, root):
    from pageloom.plans import reports

    path = path_for(spark, "results")
    records.write_results_csv(reports.knn_experiment(spark, root).where("table_name = 'whole' and k = 10"), path)
    return records.read_results_csv(spark, path).select("query_id", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("best"))


def file_manifest(spark, root):
    path, base = f"{path_for(spark, 'manifest')}/layout.json", base_vectors(spark, root)
    layout = pages.paged(orders.scattered_order(base), CAPACITY)
    access = base.select("vec_id", (F.col("vec_id") % 7).cast("double").alias("access_score"))
    sinks.write_manifest(layout, path, CAPACITY, "partition", access)
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select("system", "num_vectors", "num_pages", "page_capacity", F.array_join("permutation_head", " ").alias("head"), F.array_join(F.transform("top_access", lambda t: t[0].cast("long").cast("string")), " ").alias("top"))


def _parts(spark, root):
    base = base_vectors(spark, root)
    layout = orders.scattered_order(base)
    members = base.select(F.col("label").alias("posting_id"), "vec_id")
    postings = orders.posting_order(layout, members, base.select("vec_id", (F.col("vec_id") % 7).cast("double").alias("access_score")))
    return pages.paged(layout, CAPACITY), members, postings


def artifact_bytes(spark, root):
    """(name, bytes): every binary artifact of one layout, as hexadecimal digits."""
    folder = path_for(spark, "artifacts")
    layout, members, postings = _parts(spark, root)
    lists = sinks.posting_lists(postings, members, layout)
    sinks.write_partition_bin(layout, f"{folder}/partition.bin", CAPACITY)
    sinks.write_id_map(layout, f"{folder}/id_map.bin")
    sinks.write_page_groups(layout, f"{folder}/page_groups.bin", CAPACITY)
    sinks.write_assignment(layout, f"{folder}/assignment.bin")
    sinks.write_vector_to_posting(members, f"{folder}/vector_to_posting.bin")
    sinks.write_posting_pages(lists, f"{folder}/posting_pages.bin")
    sinks.write_posting_pages(lists, f"{folder}/posting_pages_2.bin", CAPACITY)
    name = F.regexp_extract("path", r"([a-z_0-9]+)\.bin$", 1)
    return spark.read.format("binaryFile").load(folder).select(name.alias("name"), F.lower(F.hex("content")).alias("bytes"))


def artifact_posting_order(spark, root):
    """(ord, posting_id, score) read from the artifact."""
    path = f"{path_for(spark, 'artifacts')}/posting_order.bin"
    *_, postings = _parts(spark, root)
    sinks.write_posting_order(postings, path)

    def parse(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                n = int(np.frombuffer(raw, "<u8", 1)[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.frombuffer(raw, "<u4", n, 8).astype(np.int64)), pa.array(np.frombuffer(raw, "<f8", n, 8 + 4 * n))], ["ord", "posting_id", "score"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "ord long, posting_id long, score double")


QUERIES = {
    f.__name__: f
    for f in (
        file_fvecs, file_ivecs, file_fbin, file_fbin_cropped, file_ibin, file_u8bin, file_layout_csv, file_cluster_csv, file_plain_csv, file_query_csv, file_membership, file_windows_json,
        file_families_json, file_predicates, file_window_queries, file_results_csv, file_manifest, artifact_bytes, artifact_posting_order,
    )
}


def _u32(x: str) -> str:
    return f"printf('%02x%02x%02x%02x', cast(({x}) & 255 as int), cast((({x}) >> 8) & 255 as int), cast((({x}) >> 16) & 255 as int), cast((({x}) >> 24) & 255 as int))"


def _u64(x: str) -> str:
    return f"{_u32(x)} || '00000000'"


_VECTOR = "select vec_id, 64::bigint as n, round(embedding[1]::double, 6) + 0.0 as first, round(embedding[64]::double, 6) + 0.0 as last from embeddings"
_POS = "o as (select vec_id, label, row_number() over (order by (vec_id * 2654435761) % 4294967296, vec_id) - 1 as pos from embeddings)"
_POSTINGS = "ps as (select label as posting_id, sum(cast(vec_id % 7 as double)) as score, min(pos) as first_pos from o group by 1), po as (select *, row_number() over (order by score desc, first_pos, posting_id) - 1 as ord from ps)"
_ARTIFACTS = (
    f"with {_POS}, {_POSTINGS}, c as (select count(*) as n, max(pos) // {CAPACITY} + 1 as p from o), "
    f"pg as (select string_agg(h, '' order by page) as h from (select pos // {CAPACITY} as page, {_u32('count(*)')} || string_agg({_u32('vec_id')}, '' order by pos) as h from o group by 1)), "
    f"inv as (select string_agg({_u32(f'pos // {CAPACITY}')}, '' order by vec_id) as h from o), ids as (select string_agg({_u32('vec_id')}, '' order by pos) as h from o), vp as (select string_agg({_u32('label')}, '' order by vec_id) as h from o), "
    f"pl as (select count(*) as k, string_agg(h, '' order by ord) as h from (select ord, {_u32('count(*)')} || string_agg({_u32('vec_id')}, '' order by pos) as h from o join po on label = posting_id group by ord)) "
    f"select 'partition' as name, {_u64(str(CAPACITY))} || {_u64('p')} || {_u64('n')} || pg.h || inv.h as bytes from c, pg, inv "
    f"union all select 'id_map', {_u32('n')} || {_u32('1')} || ids.h from c, ids "
    f"union all select 'page_groups', {_u64('p')} || {_u64(str(CAPACITY))} || pg.h || {_u64('n')} || inv.h from c, pg, inv "
    f"union all select 'assignment', {_u64('n')} || {_u64('p')} || inv.h from c, inv "
    f"union all select 'vector_to_posting', {_u64('n')} || vp.h from c, vp "
    f"union all select 'posting_pages', {_u64('k')} || pl.h from pl "
    f"union all select 'posting_pages_2', {_u64('k')} || {_u64(str(CAPACITY))} || pl.h from pl"
)
ORACLES = {
    "file_fvecs": _VECTOR,
    "file_ivecs": "select vec_id, 3::bigint as n, label::double as first, (vec_id % 7)::double as last from embeddings",
    "file_fbin": _VECTOR,
    "file_fbin_cropped": f"{_VECTOR} where vec_id < 100",
    "file_ibin": "select vec_id, 2::bigint as n, label::double as first, (vec_id % 9)::double as last from embeddings",
    "file_u8bin": "select vec_id, 2::bigint as n, label::double as first, (vec_id % 200)::double as last from embeddings",
    "file_layout_csv": f"with {_POS} select e.*, pos * 2 as score from ({_VECTOR}) e join o using (vec_id)",
    "file_cluster_csv": "select vec_id, 6::bigint as n, round(embedding[1]::double, 6) + 0.0 as first, round(embedding[6]::double, 6) + 0.0 as last, label as cluster_label from embeddings",
    "file_plain_csv": "select vec_id, 8::bigint as n, round(embedding[1]::double, 6) + 0.0 as first, round(embedding[8]::double, 6) + 0.0 as last from embeddings",
    "file_query_csv": "select vec_id // 10 as query_id, 6::bigint as n, round(embedding[1]::double, 6) + 0.0 as first, round(embedding[6]::double, 6) + 0.0 as last from embeddings where vec_id % 10 = 0",
    "file_membership": "select cast(label as int) as posting_id, vec_id from embeddings",
    "file_windows_json": W.ORACLES["query_windows"],
    "file_families_json": W.ORACLES["layout_families_proxy"],
    "file_predicates": PP.ORACLES["predicate_rows"],
    "file_window_queries": "select vec_id // 10 as query_id, vec_id // 100 as window_id, round(embedding[1]::double, 6) + 0.0 as x from embeddings where vec_id % 10 = 0",
    "file_results_csv": f"with {BASE}, {QUERIES_CTE}, n as (select query_id, vec_id, row_number() over (partition by query_id order by round(list_distance(q, v), 9), vec_id) as r from qs, base) select query_id, count(*) as n, min(vec_id) filter (r = 1) as best from n where r <= 10 group by 1",
    "file_manifest": f"with {_POS} select 'partition' as system, count(*) as num_vectors, max(pos) // {CAPACITY} + 1 as num_pages, {CAPACITY}::bigint as page_capacity, string_agg(cast(vec_id as varchar), ' ' order by pos) filter (pos < 32) as head, (select string_agg(cast(vec_id as varchar), ' ' order by r) from (select vec_id, row_number() over (order by vec_id % 7 desc, vec_id) as r from embeddings where vec_id % 7 > 0) where r <= 32) as top from o",
    "artifact_bytes": _ARTIFACTS,
    "artifact_posting_order": f"with {_POS}, {_POSTINGS} select ord, posting_id, score from po",
}
