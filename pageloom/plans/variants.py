"""Queries over the layout variants. Centres are label centroids of the transformed vectors, so SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import vectors as V
from pageloom.operators import stats, variants
from pageloom.plans.sql import BASE, QBAR, QUERIES_CTE, centroids_of, farthest, gravity_to, numbered, placed_by
from pageloom.plans.transforms import long_form
from pageloom.sources.tables import base_vectors, query_stream


def _both(spark, root):
    return base_vectors(spark, root), query_stream(spark, root)


def _first_queries(queries, k: int):
    """k queries as centres: those with the smallest ids."""
    return queries.where(F.col("query_id") < k).select(F.col("query_id").alias("cid"), F.col("q").alias("c"))


def gravity_exact(spark, root):
    return long_form(variants.exact_self_gravity(base_vectors(spark, root)))


def layout_pulled3(spark, root):
    return variants.pulled_order(*_both(spark, root), stats.centroids, k=3).select("vec_id", "pos")


def layout_pulled10(spark, root):
    return variants.pulled_order(*_both(spark, root), stats.centroids, k=10).select("vec_id", "pos")


def layout_stacked(spark, root):
    base, queries = _both(spark, root)

    def centres(x):
        return stats.centroids(x.join(base.select("vec_id", "label"), "vec_id"))

    return variants.stacked_order(base, queries, centres).select("vec_id", "pos")


def equal_size_labels(spark, root):
    base = base_vectors(spark, root)
    return variants.equal_size_labels(base, stats.centroids(base))


def layout_equal_pulled(spark, root):
    return variants.equal_pulled_order(*_both(spark, root), stats.centroids).select("vec_id", "pos")


def layout_equal_block_pull(spark, root):
    return variants.equal_block_pull(*_both(spark, root), stats.centroids).select("vec_id", "pos")


def layout_joint_map(spark, root):
    return variants.joint_order(*_both(spark, root), 64, stats.centroids).select("vec_id", "pos")


def layout_query_map(spark, root):
    base, queries = _both(spark, root)
    k = base.select("label").distinct().count()
    return variants.query_map_order(base, queries, 64, stats.centroids, k=k).select("vec_id", "pos")


def layout_no_vertical(spark, root):
    """The ablation without the vertical step: the same order as layout_joint_map."""
    return layout_joint_map(spark, root)


def layout_counted(spark, root):
    return variants.counted_attraction_order(*_both(spark, root), stats.centroids).select("vec_id", "pos")


def layout_joint_key(spark, root):
    return variants.joint_key_order(*_both(spark, root), 64, stats.centroids).select("vec_id", "pos")


def order_first_component(spark, root):
    return variants.first_component_order(base_vectors(spark, root), 64).select("vec_id", "pos")


def query_selection(spark, root):
    queries = query_stream(spark, root)
    return variants.farthest_cluster(queries, _first_queries(queries, 3)).select("query_id", "cid")


def stacked_rows(spark, root):
    rows = variants.stacked(*_both(spark, root))
    return rows.select("vec_id", "src", V.round6(F.col("v")[0]).alias("x"))


QUERIES = {f.__name__: f for f in (gravity_exact, layout_pulled3, layout_pulled10, layout_stacked, equal_size_labels, layout_equal_pulled, layout_equal_block_pull, layout_joint_map, layout_query_map, layout_no_vertical, layout_counted, layout_joint_key, order_first_component, query_selection, stacked_rows)}

_QA = farthest("anc", "qs", "query_id", "q", 8, 128)


def _pulled(k: int) -> str:
    return f"with recursive {BASE}, {QUERIES_CTE}, {_QA}, {gravity_to('g', 'base', k)}"


_SERIAL = (
    "pref as (select vec_id, list(cid order by round(list_distance(v, c), 9), cid) as prefs from {rows}, cent group by vec_id), "
    "line as (select vec_id, prefs, row_number() over (order by (vec_id * 2654435761) % 4294967296, vec_id) as i, count(*) over () as n from pref), "
    "ks as (select list(cid order by cid) as ks, count(*) as k, (select count(*) from base) as n from cent), "
    "turn as (select 0::bigint as i, null::bigint as vec_id, null::bigint as cid, list_transform(range(k), lambda j: n // k + case when j < n % k then 1 else 0 end) as room from ks "
    "union all select i, vec_id, cid, list_transform(room, lambda r, j: r - case when ks[j] = cid then 1 else 0 end) from "
    "(select line.i, line.vec_id, list_filter(line.prefs, lambda c: turn.room[list_position(ks.ks, c)] > 0)[1] as cid, turn.room, ks.ks from turn join line on line.i = turn.i + 1, ks)), "
    "lab as (select vec_id, cid from turn where i > 0)"
)
_LABEL_SUMS = "sums as (select a.cid, sum(list_distance(a.c, b.c)) as total from cent a, cent b group by a.cid)"
ORACLES = {
    "gravity_exact": f"with {BASE}, n as (select a.vec_id, b.vec_id as o, b.v as a, list_distance(a.v, b.v) as d, row_number() over (partition by a.vec_id order by case when a.vec_id = b.vec_id then 0 else 1 end, round(list_distance(a.v, b.v), 9), b.vec_id) as r from base a, base b), "
    "d1 as (select vec_id, d as d1 from n where r = 2), dc as (select avg(d1) as dc from d1), "
    "f as (select vec_id, generate_subscripts(a, 1) as i, unnest(a) as a, d from n where r between 2 and 4), x as (select vec_id, generate_subscripts(v, 1) as i, unnest(v) as x from base) "
    "select x.vec_id, cast(x.i - 1 as int) as i, round(any_value(x) + 0.3 * (1 + sum(dc * d1 / greatest(d * d, 1e-8) * (a - x))), 6) + 0.0 as x from x join f using (vec_id, i) join d1 using (vec_id), dc group by x.vec_id, x.i",
    "layout_pulled3": f"{_pulled(3)}, {centroids_of('g')}, {placed_by('g')} select vec_id, pos from o",
    "layout_pulled10": f"{_pulled(10)}, {centroids_of('g')}, {placed_by('g')} select vec_id, pos from o",
    "layout_stacked": f"with recursive {BASE}, {QUERIES_CTE}, st as (select vec_id, v from base union all select -1 - query_id, q from qs), {farthest('anc', 'st', 'vec_id', 'v', 16, 256)}, {gravity_to('g', 'st', 3, own=True)}, {centroids_of('g')}, {placed_by('g', 'where vec_id >= 0')} select vec_id, pos from o",
    "equal_size_labels": f"with recursive {BASE}, {centroids_of('base')}, {_SERIAL.format(rows='base')} select vec_id, cid from lab",
    "layout_equal_pulled": f"{_pulled(3)}, {centroids_of('g')}, {_SERIAL.format(rows='g')}, {_LABEL_SUMS}, near as (select vec_id, cid, list_distance(v, c) as dist from g join lab using (vec_id) join cent using (cid)), {numbered('total', 'dist')} select vec_id, pos from o",
    "layout_equal_block_pull": f"with recursive {BASE}, {QUERIES_CTE}, {QBAR}, {centroids_of('base')}, {_SERIAL.format(rows='base')}, near as (select vec_id, cid, v, 1 - list_cosine_similarity(v, c) as dist from base join lab using (vec_id) join cent using (cid)), sums as (select cid, min(1 - list_cosine_similarity(v, qbar)) as total from near, qbar group by cid), {numbered('total', 'dist')} select vec_id, pos from o",
    "layout_counted": f"{_pulled(3).replace(gravity_to('g', 'base', 3), gravity_to('g0', 'base', 3))}, {QBAR}, g as (select vec_id, list_transform(v, lambda x: x / n) as v from (select vec_id, v, sqrt(list_inner_product(v, v)) as n from g0)), {centroids_of('g')}, {_SERIAL.format(rows='g')}, near as (select vec_id, cid, v, list_distance(v, c) as dist from g join lab using (vec_id) join cent using (cid)), sums as (select cid, min(1 - list_cosine_similarity(v, qbar)) as total from near, qbar group by cid), {numbered('total', 'dist')} select vec_id, pos from o",
    "query_selection": f"with {BASE}, {QUERIES_CTE}, n as (select a.query_id, b.query_id as cid, list_distance(a.q, b.q) as d, row_number() over (partition by a.query_id order by round(list_distance(a.q, b.q), 9), b.query_id) as r from qs a, qs b where b.query_id < 3), m as (select cid from n where r = 1 group by cid order by round(avg(d), 9) desc, cid limit 1) select query_id, cid from n join m using (cid) where r = 1",
    "stacked_rows": f"with {BASE}, {QUERIES_CTE} select vec_id, 'base' as src, round(v[1], 6) + 0.0 as x from base union all select -1 - query_id, 'query', round(q[1], 6) + 0.0 from qs",
}
