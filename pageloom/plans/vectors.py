"""Queries over vector arithmetic and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.functions import vectors as V
from pageloom.operators import orders, stats
from pageloom.plans.sql import BASE, CENTRES, QBAR, QUERIES_CTE
from pageloom.sources.tables import base_vectors, query_stream, table


def vec_norms(spark, root):
    v = F.col("v")
    rows = base_vectors(spark, root)
    return rows.select("vec_id", V.round6(V.norm(v)).alias("norm"), V.round6(V.norm(V.normalise(v))).alias("unit"), V.round6(V.normalise(v, 1e-8)[0]).alias("first"))


def vec_minmax_norm(spark, root):
    rows = base_vectors(spark, root)
    ends = stats.minmax(rows)
    zipped = rows.crossJoin(F.broadcast(ends)).select("vec_id", F.posexplode(F.arrays_zip("v", "lo", "hi")).alias("i", "s"))
    return zipped.select("vec_id", "i", V.quantise(F.col("s.v"), F.col("s.lo"), F.col("s.hi"), 8).alias("cell"))


def vec_mean_query_direction(spark, root):
    found = stats.mean_direction(query_stream(spark, root))
    return found.select(F.posexplode("qbar").alias("i", "x")).select("i", V.round6(F.col("x")).alias("x"))


def query_dispersion(spark, root):
    windows = query_stream(spark, root).withColumn("window_id", F.expr("query_id div 10"))
    found = stats.dispersion(windows, "q", "window_id")
    return found.select("window_id", V.round6(F.col("dispersion")).alias("dispersion"))


def covariance_matrix(spark, root):
    found = stats.covariance(base_vectors(spark, root))
    return found.select("i", "j", F.round(F.col("cov"), 8).alias("cov"))


def centroid_assign(spark, root):
    base = base_vectors(spark, root)
    found = orders.assign(base, stats.centroids(base))
    return found.select("vec_id", "cid", V.round6(F.col("dist")).alias("dist"))


def centroid_center_sums(spark, root):
    found = orders.centre_sums(stats.centroids(base_vectors(spark, root)))
    return found.select("cid", V.round6(F.col("total")).alias("total"))


def distance_cdf(spark, root):
    base = base_vectors(spark, root)
    found = orders.assign(base, stats.centroids(base)).withColumn("dist", F.round("dist", 9))
    return stats.histogram_cdf(found, "dist").select("bin", V.round6(F.col("x")).alias("x"), V.round6(F.col("y")).alias("y"))


def combine_runs(spark, root):
    return stats.merge_runs(table(spark, root, "events"), "event_id", "event_type", "user_id").select("user_id", F.col("run").cast("long").alias("run"), "event_type", "first", "last", "n")


def combine_runs_whole(spark, root):
    """The events as one sequence."""
    found = stats.merge_runs(table(spark, root, "events").select("event_id", (F.col("user_id") % 2).alias("side")), "event_id", "side")
    return found.select(F.col("run").cast("long").alias("run"), "side", "first", "last", "n")


def id_list_parse(spark, root):
    events = table(spark, root, "events")
    text = F.format_string("[%d, %d, %d]", F.col("event_id"), F.col("user_id"), F.col("event_id") % 7)
    ids = T.id_list(text)
    return events.select("event_id", F.size(ids).cast("long").alias("n"), ids[0].alias("a"), ids[1].alias("b"), ids[2].alias("c"))


def identifier_normalize(spark, root):
    part = table(spark, root, "part")
    return part.select("p_partkey", T.identifier(F.concat_ws("-", F.col("p_partkey") % 10, F.col("p_name"), F.col("p_brand"), F.lit("x.csv"))).alias("name"))


def md5_bucket(spark, root):
    return table(spark, root, "part").select("p_partkey", T.md5_bucket(F.col("p_name"), 97).alias("bucket"))


def short_numbers(spark, root):
    rows = table(spark, root, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("a"))
    return rows.select("o_orderpriority", T.short_number(F.round("a", 2)).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (vec_norms, vec_minmax_norm, vec_mean_query_direction, query_dispersion, covariance_matrix, centroid_assign, centroid_center_sums, distance_cdf, combine_runs, combine_runs_whole, id_list_parse, identifier_normalize, md5_bucket, short_numbers)
}
ORACLES = {
    "vec_norms": f"with {BASE} select vec_id, round(sqrt(list_inner_product(v, v)), 6) + 0.0 as norm, round(sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(v, v)), 6) as unit, round(v[1] / (sqrt(list_inner_product(v, v)) + 1e-8), 6) + 0.0 as first from base",
    "vec_minmax_norm": f"with {BASE}, x as (select vec_id, generate_subscripts(v, 1) - 1 as i, unnest(v) as x from base), m as (select i, min(x) as lo, max(x) as hi from x group by i) select vec_id, cast(i as int) as i, cast(floor((x - lo) / (hi - lo + 1e-12) * 255) as bigint) as cell from x join m using (i)",
    "vec_mean_query_direction": f"with {BASE}, {QUERIES_CTE}, {QBAR} select cast(generate_subscripts(qbar, 1) - 1 as int) as i, round(unnest(qbar), 6) + 0.0 as x from qbar",
    "query_dispersion": f"with {BASE}, {QUERIES_CTE}, w as (select query_id // 10 as window_id, q from qs), x as (select window_id, generate_subscripts(q, 1) as i, unnest(q) as x from w), m as (select window_id, list(a order by i) as c from (select window_id, i, avg(x) as a from x group by window_id, i) group by window_id) select window_id, round(avg(list_distance(q, c)), 6) + 0.0 as dispersion from w join m using (window_id) group by window_id",
    "covariance_matrix": f"with {BASE}, x as (select vec_id, generate_subscripts(v, 1) - 1 as i, unnest(v) as x from base) select cast(a.i as int) as i, cast(b.i as int) as j, round(covar_samp(a.x, b.x), 8) as cov from x a join x b on a.vec_id = b.vec_id and a.i <= b.i group by a.i, b.i",
    "centroid_assign": f"with {BASE}, {CENTRES}, d as (select vec_id, cid, list_distance(v, c) as dist, row_number() over (partition by vec_id order by round(list_distance(v, c), 9), cid) as r from base, cent) select vec_id, cid, round(dist, 6) + 0.0 as dist from d where r = 1",
    "centroid_center_sums": f"with {BASE}, {CENTRES} select a.cid, round(sum(list_distance(a.c, b.c)), 6) + 0.0 as total from cent a, cent b group by a.cid",
    "distance_cdf": f"with {BASE}, {CENTRES}, d as (select vec_id, round(min(list_distance(v, c)), 9) as dist from base, cent group by vec_id), e as (select count(*) as n, min(dist) as lo, max(dist) as hi, cast(greatest(1, least(32, ceil(sqrt(count(*))))) as int) as bins from d), b as (select cast(least(floor((dist - lo) / (hi - lo) * bins), bins - 1) as int) as bin, count(*) as k from d, e group by 1), r as (select unnest(generate_series(0, bins - 1)) as bin, n, lo, hi, bins from e) select cast(r.bin as int) as bin, round(lo + (r.bin + 1) * (hi - lo) / bins, 6) + 0.0 as x, round(sum(coalesce(k, 0)) over (order by r.bin) / n, 6) + 0.0 as y from r left join b on r.bin = b.bin",
    "combine_runs": "with a as (select user_id, event_id, event_type, case when event_type is not distinct from lag(event_type) over w and lag(event_id) over w is not null then 0 else 1 end as new from events window w as (partition by user_id order by event_id)), b as (select *, sum(new) over (partition by user_id order by event_id) as run from a) select user_id, cast(run as bigint) as run, event_type, min(event_id) as first, max(event_id) as last, count(*) as n from b group by user_id, run, event_type",
    "id_list_parse": "with t as (select event_id, list_transform(string_split(trim('[' || event_id || ', ' || user_id || ', ' || (event_id % 7) || ']', '[]'), ','), lambda x: cast(trim(x) as bigint)) as ids from events) select event_id, cast(len(ids) as bigint) as n, ids[1] as a, ids[2] as b, ids[3] as c from t",
    "identifier_normalize": "with t as (select p_partkey, regexp_replace(concat_ws('-', p_partkey % 10, p_name, p_brand, 'x.csv'), '\\.csv$', '') as s from part), u as (select p_partkey, trim(regexp_replace(lower(s), '[^a-z0-9_]+', '_', 'g'), '_') as s from t) select p_partkey, case when regexp_matches(s, '^[0-9]') then 'layout_' || s else s end as name from u",
    "md5_bucket": "select p_partkey, cast(md5_number(p_name) % 97 as bigint) as bucket from (select p_partkey, p_name from part)",
    "short_numbers": "select o_orderpriority, regexp_replace(regexp_replace(printf('%.6f', round(avg(o_totalprice), 2)), '0+$', ''), '\\.$', '') as text from orders group by o_orderpriority",
}
# md5_number reads the digest in another byte order than its hexadecimal digits, so the digits are summed instead
ORACLES["md5_bucket"] = "select p_partkey, cast(list_reduce(list_prepend(0::bigint, list_transform(string_split(md5(p_name), ''), lambda d: cast(instr('0123456789abcdef', d) - 1 as bigint))), lambda a, d: (a * 16 + d) % 97) as bigint) as bucket from part"
ORACLES["combine_runs_whole"] = "with l as (select event_id, user_id % 2 as side, case when user_id % 2 = lag(user_id % 2) over (order by event_id) then 0 else 1 end as new from events), r as (select *, sum(new) over (order by event_id) as run from l) select cast(run as bigint) as run, side, min(event_id) as first, max(event_id) as last, count(*) as n from r group by run, side"
