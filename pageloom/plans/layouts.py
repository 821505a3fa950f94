"""Queries over orderings and pages. Cluster centres are the label centroids, so SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import vectors as V
from pageloom.operators import knn, orders, pages, stats
from pageloom.plans.sql import BASE, CENTRES, NEAREST, QBAR, QUERIES_CTE
from pageloom.sources.tables import base_vectors, query_stream, table

CAPACITY = 16


def _parts(spark, root):
    base = base_vectors(spark, root)
    return base, stats.centroids(base), stats.mean_direction(query_stream(spark, root))


def _layout(make):
    def run(spark, root):
        return make(*_parts(spark, root)).select("vec_id", "pos")

    return run


order_kmeans = _layout(lambda base, cent, qbar: orders.kmeans_order(base, cent))
order_cosine = _layout(lambda base, cent, qbar: orders.cosine_order(base, cent))
order_angular_pull = _layout(lambda base, cent, qbar: orders.angular_pull_order(base, cent, qbar))
order_query_attraction = _layout(lambda base, cent, qbar: orders.attraction_order(base, cent, qbar))
order_block_pull = _layout(lambda base, cent, qbar: orders.attraction_order(base, cent, qbar, angular=True))
order_idistance = _layout(lambda base, cent, qbar: orders.idistance_order(base, cent))
order_centre_key = _layout(lambda base, cent, qbar: orders.centre_key_order(base, cent))
order_zorder8x4 = _layout(lambda base, cent, qbar: orders.z_order(base, 4, 8))
order_hash_random = _layout(lambda base, cent, qbar: orders.scattered_order(base))


def page_map(spark, root):
    base, cent, _ = _parts(spark, root)
    return pages.page_map(orders.kmeans_order(base, cent), CAPACITY).select("page_id", F.array_join("members", " ").alias("members"))


def page_zone_map(spark, root):
    base, cent, _ = _parts(spark, root)
    rows = pages.paged(orders.kmeans_order(base, cent), CAPACITY).join(orders.assign(base, cent).select("vec_id", "dist"), "vec_id")
    found = pages.zone_map(rows, "page_id", "dist")
    return found.select("page_id", V.round6(F.col("lo")).alias("lo"), V.round6(F.col("hi")).alias("hi"), "size")


def _touched(spark, root):
    base, cent, _ = _parts(spark, root)
    near = knn.exact(query_stream(spark, root), base, 10)
    return pages.touched_pages(near, orders.kmeans_order(base, cent), CAPACITY, "query_id")


def page_access_per_query(spark, root):
    return _touched(spark, root).select("query_id", "pages", "vectors")


def page_access_per_window(spark, root):
    rows = _touched(spark, root).select(F.expr("query_id div 10").alias("window_id"), F.col("pages").alias("block_num"))
    return pages.window_totals(rows)


def posting_order(spark, root):
    base = base_vectors(spark, root)
    members = base.select(F.col("label").alias("posting_id"), "vec_id")
    access = base.select("vec_id", (F.col("vec_id") % 7).cast("double").alias("access_score"))
    return orders.posting_order(orders.scattered_order(base), members, access)


def dis_labels(spark, root):
    base = base_vectors(spark, root)
    centre = stats.mean_vector(base, "v")
    keyed = base.crossJoin(F.broadcast(centre)).withColumn("d", F.round(V.l2(F.col("v"), F.col("mean")), 9))
    n = base.count()
    return orders.by_key(keyed, F.col("d")).select("vec_id", pages.equal_count_labels(F.col("pos"), n, 20).alias("bid"))


def row_window_blocks(spark, root):
    log = table(spark, root, "events").select("event_id", F.lit(None).alias("x"), F.array("event_id", "user_id", F.col("event_id") % 1000).alias("ids"))
    log = log.withColumn("block_num", pages.blocks_of(F.col("ids"), 100))
    return pages.row_windows(log, "event_id", 300).select("window_id", V.round6(F.col("avg_block")).alias("avg_block"), "total_block")


def probe_window_blocks(spark, root):
    log = table(spark, root, "events").select((F.col("event_id") % 17).alias("window_id"), (F.col("user_id") % 5).cast("int").alias("num_probes"), pages.blocks_of(F.array("event_id", "user_id"), 100).alias("block_num"))
    return pages.probe_windows(log, windows=15, seat=3)


def static_block_report(spark, root):
    log = table(spark, root, "events").select((F.col("event_id") % 4).alias("nprobe"), (F.col("user_id") % 3).alias("k"), "event_id", F.concat_ws(" ", F.col("event_id"), F.col("user_id"), F.col("event_id") + 150).alias("ids"))
    return pages.static_report(log, "ids", 100, nprobe=1, k=2).select("event_id", "block_num")


def label_disagreement(spark, root):
    base, cent, _ = _parts(spark, root)
    return stats.disagreement(base.select("vec_id", F.col("label").alias("cid")), orders.assign(base, cent), "vec_id", "cid").select(V.round6(F.col("disagreement")).alias("disagreement"))


_NAMES = """order_kmeans order_cosine order_angular_pull order_query_attraction order_block_pull order_idistance order_centre_key order_zorder8x4 order_hash_random
page_map page_zone_map page_access_per_query page_access_per_window posting_order dis_labels row_window_blocks probe_window_blocks static_block_report label_disagreement"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_ANGLE = "(1 - list_cosine_similarity({a}, {b}))"
_VC = _ANGLE.format(a="v", b="c")
_SUMS = "sums as (select a.cid, sum({d}) as total from cent a, cent b group by a.cid)"
_L2_SUMS = _SUMS.format(d="list_distance(a.c, b.c)")
_COS_SUMS = _SUMS.format(d=_ANGLE.format(a="a.c", b="b.c"))
_SCORES = f"sums as (select cid, min({_ANGLE.format(a='v', b='qbar')}) as total from near, qbar group by cid)"


def _clustered(sums: str, key: str, more: str = "") -> str:
    return f"with {BASE}, {QUERIES_CTE}, {CENTRES}, {QBAR}, {NEAREST}, {sums}, {more} o as (select vec_id, cast(row_number() over (order by round(total, 9), cid, round({key}, 9), vec_id) - 1 as bigint) as pos from near join sums using (cid), qbar)"


_KMEANS = _clustered(_L2_SUMS, "dist")
_TOUCHED = f"{_KMEANS}, k as (select query_id, vec_id, row_number() over (partition by query_id order by round(list_distance(q, v), 9), vec_id) as r from qs, base), t as (select query_id, count(distinct pos // {CAPACITY}) as pages, count(*) as vectors from k join o using (vec_id) where r <= 10 group by query_id)"
ORACLES = {
    "order_kmeans": f"{_KMEANS} select * from o",
    "order_cosine": f"{_clustered(_COS_SUMS, _VC)} select * from o",
    "order_angular_pull": f"{_clustered(_COS_SUMS, _VC + ' - 0.3 * list_cosine_similarity(v, qbar)')} select * from o",
    "order_query_attraction": f"{_clustered(_SCORES, 'dist')} select * from o",
    "order_block_pull": f"{_clustered(_SCORES, _VC)} select * from o",
    "order_idistance": f"with {BASE}, {CENTRES}, {NEAREST}, r as (select cid, row_number() over (order by round(sqrt(list_inner_product(c, c)), 9), cid) - 1 as r from cent), p as (select max(list_max(v)) - min(list_min(v)) as ptp from base) select vec_id, cast(row_number() over (order by round(r * (ptp + 1e-6) + dist, 9), vec_id) - 1 as bigint) as pos from near join r using (cid), p",
    "order_centre_key": f"with {BASE}, {CENTRES}, {NEAREST}, {_L2_SUMS} select vec_id, cast(row_number() over (order by round(dist + total, 9), vec_id) - 1 as bigint) as pos from near join sums using (cid)",
    "order_zorder8x4": f"with {BASE}, m as (select "
    + ", ".join(f"min(v[{d}]) as l{d}, max(v[{d}]) as h{d}" for d in range(1, 5))
    + " from base), g as (select vec_id, "
    + ", ".join(f"cast(floor((v[{d}] - l{d}) / (h{d} - l{d} + 1e-12) * 255) as bigint) as g{d}" for d in range(1, 5))
    + " from base, m) select vec_id, cast(row_number() over (order by "
    + " + ".join(f"(((g{d} >> {b}) & 1) << {b * 4 + d - 1})" for b in range(8) for d in range(1, 5))
    + ", vec_id) - 1 as bigint) as pos from g",
    "order_hash_random": "select vec_id, cast(row_number() over (order by (vec_id * 2654435761) % 4294967296, vec_id) - 1 as bigint) as pos from embeddings",
    "page_map": f"{_KMEANS} select pos // {CAPACITY} as page_id, string_agg(cast(vec_id as varchar), ' ' order by pos) as members from o group by 1",
    "page_zone_map": f"{_KMEANS} select pos // {CAPACITY} as page_id, round(min(dist), 6) + 0.0 as lo, round(max(dist), 6) + 0.0 as hi, count(*) as size from o join near using (vec_id) group by 1",
    "page_access_per_query": f"{_TOUCHED} select query_id, pages, vectors from t",
    "page_access_per_window": f"{_TOUCHED} select query_id // 10 as window_id, count(*) as rows_in_window, round(avg(pages), 6) as avg_block, cast(sum(pages) as bigint) as total_block from t group by 1",
    "posting_order": "with p as (select vec_id, row_number() over (order by (vec_id * 2654435761) % 4294967296, vec_id) - 1 as pos from embeddings), s as (select label as posting_id, sum(cast(vec_id % 7 as double)) as score, min(pos) as first_pos from embeddings join p using (vec_id) group by 1) select posting_id, score, cast(first_pos as bigint) as first_pos, cast(row_number() over (order by score desc, first_pos, posting_id) - 1 as bigint) as ord from s",
    "dis_labels": f"with {BASE}, c as (select list(a order by i) as c from (select i, avg(x) as a from (select generate_subscripts(v, 1) as i, unnest(v) as x from base) group by i)), p as (select vec_id, row_number() over (order by round(list_distance(v, c), 9), vec_id) - 1 as pos, count(*) over () as n from base, c) select vec_id, cast(least(pos // (n // 20 + 1), 19) as bigint) as bid from p",
    "row_window_blocks": "with b as (select event_id, len(list_distinct([event_id // 100, user_id // 100, (event_id % 1000) // 100])) as block_num from events) select event_id // 300 + 1 as window_id, round(avg(block_num), 6) as avg_block, cast(sum(block_num) as bigint) as total_block from b group by 1 having count(*) = 300",
    "probe_window_blocks": "with b as (select event_id % 17 as window_id, user_id % 5 as p, len(list_distinct([event_id // 100, user_id // 100])) as n from events) select w as window_id, cast(coalesce(sum(case when p between 1 and 3 then n end), 0) as bigint) as upto_seat, cast(coalesce(sum(case when p = 3 then n end), 0) as bigint) as at_seat from range(15) t(w) left join b on b.window_id = w group by w",
    "static_block_report": "select event_id, cast(len(list_distinct([event_id // 100, user_id // 100, (event_id + 150) // 100])) as bigint) as block_num from events where event_id % 4 = 1 and user_id % 3 = 2",
    "label_disagreement": f"with {BASE}, {CENTRES}, {NEAREST} select round(1 - count(*) filter (label = cid) / count(*), 6) + 0.0 as disagreement from near join base using (vec_id)",
}
