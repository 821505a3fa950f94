"""Queries over windows of the query stream, partial layouts, costs and switching."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import vectors as V
from pageloom.operators import knn, orders, pages, partial, policies, profiles, stats, workload
from pageloom.operators.ranking import ranked
from pageloom.plans.sql import BASE, CENTRES, NEAREST, QUERIES_CTE
from pageloom.sources.tables import base_vectors, query_stream, table

WINDOW, NEIGHBOURS, HOT = 10, 10, 32
CAPACITY, BETA, K, A = 16, 0.5, 10, 1.5


def query_windows(spark, root):
    return workload.windows(query_stream(spark, root), WINDOW)


def _hot(spark, root):
    return workload.hot_vectors(query_stream(spark, root), base_vectors(spark, root), WINDOW, NEIGHBOURS, HOT)


def hot_vectors(spark, root):
    return _hot(spark, root).withColumn("score", V.round6(F.col("score")))


def hot_overlap(spark, root):
    return workload.hot_overlap(_hot(spark, root))


def window_representative(spark, root):
    return workload.representatives(query_stream(spark, root), WINDOW).select("window_id", "query_id", V.round6(F.col("density")).alias("density"))


def kde_representative(spark, root):
    scores = workload.kde_scores(query_stream(spark, root), base_vectors(spark, root))
    rows = workload.with_window(scores, WINDOW).withColumn("score", F.round("score", 6))
    best = rows.groupBy("window_id").agg(F.max(F.struct("score", (-F.col("query_id")).alias("neg"))).alias("m"))
    return best.select("window_id", (-F.col("m.neg")).alias("query_id"), F.col("m.score").alias("score"))


def rtbs_weighted_sample(spark, root):
    rows = workload.with_window(query_stream(spark, root), WINDOW).select("query_id", "window_id")
    return workload.biased_sample(rows, "query_id", 12, F.exp(2.0 * (F.col("query_id") + 1) / 50.0))


def sliding_window_last_w(spark, root):
    return workload.last_rows(table(spark, root, "events").select("user_id", "event_id", "event_type"), "event_id", 5, "user_id")


def _windows(spark, root):
    """The base, the representative of each window as that of its layout, and the queries with their layouts."""
    reps = workload.representatives(query_stream(spark, root), WINDOW).select(F.col("window_id").alias("layout_id"), F.col("q").alias("rep"))
    queries = workload.with_window(query_stream(spark, root), WINDOW).withColumnRenamed("window_id", "layout_id")
    return base_vectors(spark, root), reps, queries


def _layouts(spark, root):
    """The windows with a row for each layout and vector in it."""
    base, reps, queries = _windows(spark, root)
    return base, reps, queries, partial.partial_layouts(base, reps, CAPACITY, BETA)


def partial_layout_blocks(spark, root):
    base, reps, _ = _windows(spark, root)
    metas = profiles.block_metas(base, reps, CAPACITY, BETA)
    return metas.select("layout_id", "block_id", V.round6(F.col("dmin")).alias("dmin"), V.round6(F.col("dmax")).alias("dmax"), "size")


def partial_layout_cost(spark, root):
    found = profiles.own_costs(*_windows(spark, root), CAPACITY, BETA)
    return found.select("query_id", V.round6(F.col("cost")).alias("cost"))


def partial_smooth_cost(spark, root):
    found = profiles.smooth_costs(*_windows(spark, root), CAPACITY, BETA, K)
    return found.select("query_id", "layout_id", V.round6(F.col("cost")).alias("cost"))


def _search(spark, root):
    base, reps, queries = _windows(spark, root)
    return base, queries, profiles.search(base, reps, queries, CAPACITY, BETA, K, A)


def partial_search(spark, root):
    *_, found = _search(spark, root)
    return found.select("query_id", "layout_id", F.array_join("neighbours", " ").alias("neighbours"), "candidates", "touched")


def partial_fallback_summary(spark, root):
    base, queries, found = _search(spark, root)
    rows = partial.search_with_fallback(found, base, queries, K)
    return rows.groupBy(F.col("layout_id").alias("window_id")).agg(F.count("*").alias("query_count"), F.count_if("fallback").alias("fallback_count"), V.round6(F.avg("recall")).alias("mean_recall"))


def _dis(spark, root):
    base = base_vectors(spark, root)
    centre = stats.mean_vector(base, "v")
    keyed = base.crossJoin(F.broadcast(centre)).select("vec_id", F.round(V.l2(F.col("v"), F.col("mean")), 9).alias("s"))
    n = base.count()
    placed = ranked(keyed, "s", "vec_id").withColumn("block_id", pages.equal_count_labels(F.col("rank"), n, 20))
    return base, centre, n, placed.groupBy("block_id").agg(F.min("s").alias("dmin"), F.max("s").alias("dmax"), F.count("*").alias("size"))


def dis_block_meta(spark, root):
    *_, metas = _dis(spark, root)
    return metas.select("block_id", V.round6(F.col("dmin")).alias("dmin"), V.round6(F.col("dmax")).alias("dmax"), "size")


def dis_read_fraction(spark, root):
    base, centre, n, metas = _dis(spark, root)
    radius = partial.second_neighbour_radius(partial.radius_sample(base), base)
    found = partial.interval_read_fraction(query_stream(spark, root), metas, centre, radius, n)
    return found.select("query_id", "blocks", V.round6(F.col("fraction")).alias("fraction"))


def _families(spark, root):
    queries = query_stream(spark, root)
    rows = workload.windows(queries, WINDOW).join(stats.dispersion(workload.with_window(queries, WINDOW), "q", "window_id"), "window_id")
    return partial.proxy_families(rows.join(workload.hot_overlap(_hot(spark, root)), "window_id"))


def layout_families_proxy(spark, root):
    return _families(spark, root).withColumns({c: V.round6(F.col(c)) for c in ("query_cost", "movement_cost")})


def _rounded(events):
    return events.withColumns({c: V.round6(F.col(c)) for c in ("query_cost", "movement_cost")})


def _ordered(families):
    place = F.when(F.col("layout_label") == "base", 0).when(F.col("layout_label") == "hot", 1).otherwise(2)
    return families.withColumn("ord", place)


def switch_greedy(spark, root):
    return _rounded(policies.greedy(_ordered(_families(spark, root)), alpha=0.01, threshold=0.1))


def switch_sticky(spark, root):
    return _rounded(policies.greedy(_ordered(_families(spark, root)), threshold=0.1, sticky=True))


def switch_counter(spark, root):
    return _rounded(policies.counter(_ordered(_families(spark, root)), alpha=20.0, seed=3))


def replay_summary(spark, root):
    found = policies.summary(_rounded(policies.greedy(_ordered(_families(spark, root)), threshold=0.1, sticky=True)))
    return found.select(*[V.round6(F.col(c)).alias(c) for c in ("total_query_cost", "total_movement_cost", "total_cost")], "switch_count", "window_count")


def schedule_tables(spark, root):
    return policies.schedule_tables(workload.windows(query_stream(spark, root), WINDOW), "demo", "ivfflat")


def _state_costs(spark, root):
    """Costs of 4 states in every window of 20 events, from the first window to the last; 0 where there is no event."""
    rows = table(spark, root, "events").select(F.expr("event_id div 20").alias("window_id"), (F.col("user_id") % 4).alias("state"), F.abs("value").alias("value"))
    ends = rows.agg(F.min("window_id").alias("lo"), F.max("window_id").alias("hi")).where("lo is not null")
    grid = ends.select(F.explode(F.sequence("lo", "hi")).alias("window_id")).crossJoin(spark.range(4).withColumnRenamed("id", "state"))
    sums = rows.groupBy("window_id", "state").agg(F.round(F.sum("value"), 6).alias("c"))
    return grid.join(sums, ["window_id", "state"], "left").select("window_id", "state", F.coalesce("c", F.lit(0.0)).alias("cost"))


def wfa_trace(spark, root):
    return policies.work_function(_state_costs(spark, root), alpha=50.0).withColumn("work", V.round6(F.col("work")))


def regret_trace(spark, root):
    return policies.regret(_state_costs(spark, root), alpha=500.0)


def phased_trace(spark, root):
    return policies.phased(_state_costs(spark, root), alpha=2000.0, seed=5)


def cost_profiles(spark, root):
    """The base, the queries with their layouts, and the costs of all queries in every layout."""
    base, reps, queries = _windows(spark, root)
    return base, queries, profiles.profiles(base, reps, queries, CAPACITY, BETA)


def cost_profile_distance(spark, root):
    """(layout_id, distance): how far each layout's costs for all queries lie from those of the layout after it."""
    *_, found = cost_profiles(spark, root)
    return profiles.successive_distances(found).select("layout_id", V.round6(F.col("d")).alias("distance"))


def knn_single_topk(spark, root):
    one = query_stream(spark, root).where("query_id = 0")
    return knn.nearest(base_vectors(spark, root), one, 10).select("vec_id", V.round6(F.col("distance")).alias("distance"))


def knn_ground_truth_recall(spark, root):
    queries, base = query_stream(spark, root), base_vectors(spark, root)
    half = knn.exact(queries, base.where("vec_id % 2 = 0"), K)
    return knn.recall(half, knn.exact(queries, base, K), K).select("query_id", "hits", V.round6(F.col("recall")).alias("recall"))


def ivf_probe_knn(spark, root):
    base = base_vectors(spark, root)
    cells = orders.assign(base, stats.centroids(base))
    found = knn.probed(query_stream(spark, root), cells.select("vec_id", "v", "cid"), stats.centroids(base), probes=2, k=K)
    return found.withColumn("distance", V.round6(F.col("distance")))


def dis_partial_cost(spark, root):
    base, centre, n, metas = _dis(spark, root)
    radius = partial.second_neighbour_radius(partial.radius_sample(base), base)
    found = partial.prefix_or_full(query_stream(spark, root), metas, centre, radius, n, 0.8)
    return found.withColumn("fraction", V.round6(F.col("fraction")))


def materialised_families(spark, root):
    queries = query_stream(spark, root)
    rows = workload.windows(queries, WINDOW).join(stats.dispersion(workload.with_window(queries, WINDOW), "q", "window_id"), "window_id")
    found = partial.materialised_families(rows, workload.hot_overlap(_hot(spark, root)), 0.3)
    return found.withColumns({c: V.round6(F.col(c)) for c in ("query_cost", "movement_cost")})


def running_state_costs(spark, root):
    return workload.running_costs(_state_costs(spark, root)).withColumns({c: V.round6(F.col(c)) for c in ("cost", "total")})


def random_sets(spark, root):
    found = workload.random_sets(table(spark, root, "part"), "p_brand", 20, 3, 9)
    return found.select("query_id", F.array_join("values", ",").alias("values"))


def random_spans(spark, root):
    found = workload.random_spans(table(spark, root, "orders"), "o_orderdate", 20, 30, 4)
    return found.select("query_id", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("lo", "hi")])


def template_workload(spark, root):
    walk = workload.markov_templates(spark, templates=5, length=200, stay=0.6, seed=7)
    ranges = workload.random_ranges(table(spark, root, "lineitem"), "l_quantity", n=30, selectivity=0.2, seed=3)
    return workload.filled_templates(walk, ranges, 30).withColumns({c: V.round6(F.col(c)) for c in ("lo", "hi")})


def resampled_rows(spark, root):
    found = workload.resampled_rows(base_vectors(spark, root), (2, 5), 300, 6)
    return found.select("row_id", *[V.round6(F.col("v")[i]).alias(f"x{i}") for i in (0, 2, 5)])


def sampled_files(spark, root):
    rows = table(spark, root, "orders").select("o_orderkey", F.col("o_orderstatus").alias("file"))
    return workload.sampled_files(rows, "file", "o_orderkey", 100, 0.05, 2)


def neighbour_samples(spark, root):
    found = workload.neighbour_samples(query_stream(spark, root), base_vectors(spark, root), [1, 5, 10], 8)
    return found.withColumn("k", F.col("k").cast("long"))


_NAMES = """query_windows hot_vectors hot_overlap window_representative kde_representative rtbs_weighted_sample sliding_window_last_w partial_layout_blocks partial_layout_cost
partial_smooth_cost partial_search partial_fallback_summary dis_block_meta dis_read_fraction layout_families_proxy switch_greedy switch_sticky switch_counter replay_summary
schedule_tables wfa_trace phased_trace regret_trace cost_profile_distance knn_single_topk knn_ground_truth_recall ivf_probe_knn
dis_partial_cost materialised_families running_state_costs random_sets random_spans template_workload resampled_rows sampled_files neighbour_samples"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_HOT = (
    f"k as (select query_id, vec_id, row_number() over (partition by query_id order by round(list_distance(q, v), 9), vec_id) as r from qs, base), "
    f"votes as (select query_id // {WINDOW} as window_id, vec_id, round(sum(1.0::double / r), 9) as score from k where r <= {NEIGHBOURS} group by 1, 2), "
    f"hot as (select * from (select *, row_number() over (partition by window_id order by score desc, vec_id) as rank from votes) where rank <= {HOT}), "
    "sets as (select window_id, list(vec_id) as s from hot group by 1), "
    "overlap as (select window_id, cast(len(s) as bigint) as hot_count, cast(coalesce(len(list_intersect(s, lag(s) over (order by window_id))), 0) as bigint) as overlap from sets)"
)
_REPS = (
    f"w as (select query_id // {WINDOW} as window_id, query_id, q from qs), "
    "h as (select window_id, greatest(stddev_pop(x), 1e-6) as h from (select window_id, unnest(q) as x from w) group by 1), "
    "dens as (select a.window_id, a.query_id, round(sum(exp(-pow(list_distance(a.q, b.q), 2) / (2 * h * h))), 9) as density from w a join w b using (window_id) join h using (window_id) group by 1, 2), "
    "rep as (select window_id, query_id, density, q as rep from (select *, row_number() over (partition by window_id order by density desc, query_id) as r from dens) join qs using (query_id) where r = 1)"
)
_MEMBERS = (
    f"n as (select count(*) as n, cast(least(count(*), greatest(1, ceil(ceil(count(*) / {CAPACITY}::double) * {BETA})) * {CAPACITY}) as bigint) as cov from base), "
    "ranks as (select window_id as layout_id, vec_id, v, round(list_distance(v, rep), 9) as s, row_number() over (partition by window_id order by round(list_distance(v, rep), 9), vec_id) - 1 as rank from base, rep), "
    f"mem as (select ranks.*, rank // {CAPACITY} as block_id from ranks, n where rank < cov), "
    "metas as (select layout_id, block_id, min(s) as dmin, max(s) as dmax, count(*) as size from mem group by 1, 2)"
)
_P = f"with {BASE}, {QUERIES_CTE}, {_REPS}, {_MEMBERS}"
_GAPS = (
    "ends as (select layout_id, unnest([dmin, dmax]) as d from metas), steps as (select layout_id, d, d - lag(d) over (partition by layout_id order by d) as g from ends), "
    "rad as (select layout_id, 0.5 * greatest(1e-6, coalesce(median(g) filter (g > 0), max(d))) as r from steps group by 1)"
)
_SEARCH = (
    f"pq as (select w.query_id, w.window_id as layout_id, q, round(list_distance(q, rep), 9) as sq from w join rep using (window_id)), "
    "pr as (select query_id, layout_id, vec_id, s, rank, sq, round(list_distance(v, q), 9) as d from mem join pq using (layout_id)), "
    "sd as (select query_id, least(count(*) filter (s < sq), count(*) - 1) as c from pr group by 1), "
    "rr as (select *, rank <= c as lft, row_number() over (partition by query_id order by d, vec_id) as ra, row_number() over (partition by query_id, rank <= c order by d, vec_id) as rl from pr join sd using (query_id)), "
    "g as (select query_id, layout_id, any_value(c) as c, any_value(sq) as sq, count(*) as n, min(s) as s0, max(s) as s1, max(case when lft and rl = 15 then d end) as dl, max(case when ra = 15 then d end) as da, "
    "list(vec_id order by d, vec_id) filter (ra <= 10) as nb, count(*) filter (ra <= 15) as candidates from rr group by 1, 2), "
    "found as (select *, (c = 0 or not (c + 1 >= 15 and coalesce(abs(s0 - sq) >= dl, false))) or (c = n - 1 or not (n >= 15 and coalesce(abs(s1 - sq) >= da, false))) as touched from g)"
)
_DIS = (
    f"with {BASE}, {QUERIES_CTE}, c as (select list(a order by i) as c from (select i, avg(x) as a from (select generate_subscripts(v, 1) as i, unnest(v) as x from base) group by i)), "
    "p as (select vec_id, round(list_distance(v, c), 9) as s, row_number() over (order by round(list_distance(v, c), 9), vec_id) - 1 as pos, count(*) over () as n from base, c), "
    "metas as (select cast(least(pos // (n // 20 + 1), 19) as bigint) as block_id, min(s) as dmin, max(s) as dmax, count(*) as size from p group by 1)"
)
_FAMILIES = (
    f"with {BASE}, {QUERIES_CTE}, {_HOT}, w as (select query_id // {WINDOW} as window_id, q from qs), m as (select window_id, list(a order by i) as c from (select window_id, i, avg(x) as a from (select window_id, generate_subscripts(q, 1) as i, unnest(q) as x from w) group by 1, 2) group by 1), "
    "disp as (select window_id, count(*) as n, avg(list_distance(q, c)) as dispersion from w join m using (window_id) group by 1), "
    "kinds as (select * from (values (0, 'base', 1.0::double), (1, 'hot', 0.72::double), (2, 'balanced', 0.88::double)) t(ord, layout_label, f)), "
    "fam as (select window_id, ord, 'window' || window_id || '_' || layout_label as candidate_id, layout_label, greatest(1.0::double, n * (1 + dispersion) * f) as query_cost, "
    "cast(case layout_label when 'base' then 0 when 'hot' then greatest(1.0, hot_count - overlap) else greatest(0.5, (hot_count - overlap) * 0.5) end as double) as movement_cost from disp join overlap using (window_id), kinds)"
)


# a window has the same three labels, so staying is always possible
_WALK = (
    "{families}, pick as (select a.window_id, a.layout_label as prev, (case when {move} then b.layout_label else a.layout_label end) as next from fam a join (select *, row_number() over (partition by window_id order by {best}, candidate_id) as r from fam) b on b.window_id = a.window_id and b.r = 1), "
    "walk as (select 0::bigint as window_id, 'base' as layout_label, 'base' as prev union all select pick.window_id, pick.next, walk.layout_label from walk join pick on pick.window_id = walk.window_id + 1 and pick.prev = walk.layout_label), "
    "events as (select fam.window_id, candidate_id as chosen_candidate_id, fam.layout_label, round(query_cost, 6) + 0.0 as query_cost, case when walk.prev <> walk.layout_label then round(movement_cost, 6) + 0.0 else 0.0 end as movement_cost, walk.prev <> walk.layout_label as switched from walk join fam on fam.window_id = walk.window_id and fam.layout_label = walk.layout_label)"
)
_GREEDY = _WALK.format(families=_FAMILIES.replace("with ", "with recursive ", 1), best="query_cost + 0.01 * movement_cost", move="b.query_cost + 0.01 * b.movement_cost + 0.1 < a.query_cost + 0.01 * a.movement_cost")
_STICKY = _WALK.format(families=_FAMILIES.replace("with ", "with recursive ", 1), best="query_cost + movement_cost", move="b.layout_label <> a.layout_label and a.query_cost - b.query_cost > 0.1")
_COSTS = "ends as (select min(event_id // 20) as lo, max(event_id // 20) as hi from events), costs as (select w as window_id, s as state, coalesce(c, 0) as cost from (select unnest(generate_series(lo, hi)) as w from ends) a cross join (select unnest(range(4)) as s) b left join (select event_id // 20 as w2, user_id % 4 as s2, round(sum(abs(value)), 6) as c from events group by 1, 2) on w2 = w and s2 = s), piv as (select window_id, list(cost order by state) as c from costs group by 1)"


_PROFILES = (
    "far as (select qs.query_id, window_id as layout_id, round(list_distance(q, rep), 9) as dq from qs, rep), "
    "hits as (select query_id, layout_id, count(*) filter (abs((dmin + dmax) * 0.5 - dq) <= r + 1e-12) as h from far join metas using (layout_id) join rad using (layout_id) group by 1, 2), "
    f"prof as (select query_id, layout_id, case when h = 0 then 1.0 else h / ceil(n / {CAPACITY}::double) end as cost from hits, n)"
)


ORACLES = {
    "query_windows": f"select query_id // {WINDOW} as window_id, min(query_id) as start_query_id, max(query_id) as end_query_id, count(*) as query_count, 'window_' || (query_id // {WINDOW}) as workload_label from (select vec_id // 10 as query_id from embeddings where vec_id % 10 = 0) group by query_id // {WINDOW}",
    "hot_vectors": f"with {BASE}, {QUERIES_CTE}, {_HOT} select window_id, rank, vec_id, round(score, 6) as score from hot",
    "hot_overlap": f"with {BASE}, {QUERIES_CTE}, {_HOT} select * from overlap",
    "window_representative": f"with {BASE}, {QUERIES_CTE}, {_REPS} select window_id, query_id, round(density, 6) as density from rep",
    "kde_representative": f"with {BASE}, {QUERIES_CTE}, x as (select generate_subscripts(v, 1) as i, unnest(v) as x from base), h as (select i, stddev_samp(x) * pow(count(*), -0.2) as h, count(*) as n from x group by i), qx as (select query_id, generate_subscripts(q, 1) as i, unnest(q) as q from qs), s as (select query_id, round(sum(exp(-pow(q - x, 2) / (2 * h * h)) / (n * h * sqrt(2 * 3.141592653589793))), 6) as score from qx join x using (i) join h using (i) group by 1) select window_id, query_id, score from (select query_id // {WINDOW} as window_id, query_id, score, row_number() over (partition by query_id // {WINDOW} order by score desc, query_id) as r from s) where r = 1",
    "rtbs_weighted_sample": f"select query_id, query_id // {WINDOW} as window_id from (select vec_id // 10 as query_id from embeddings where vec_id % 10 = 0) order by round(-ln((((query_id * 2654435761) % 1000003) + 1) / 1000005.0::double) / exp(2.0::double * (query_id + 1) / 50.0::double), 9), query_id limit 12",
    "sliding_window_last_w": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r <= 5",
    "partial_layout_blocks": f"{_P} select layout_id, block_id, round(dmin, 6) + 0.0 as dmin, round(dmax, 6) + 0.0 as dmax, size from metas",
    "partial_layout_cost": f"{_P}, {_GAPS}, aq as (select w.query_id, w.window_id as layout_id, round(list_distance(q, rep), 9) as dq from w join rep using (window_id)) select query_id, round(case when count(*) filter (abs((dmin + dmax) * 0.5 - dq) <= r + 1e-12) = 0 then 1.0 else count(*) filter (abs((dmin + dmax) * 0.5 - dq) <= r + 1e-12) / ceil(n / {CAPACITY}::double) end, 6) + 0.0 as cost from aq join rad using (layout_id) join metas using (layout_id), n group by query_id, n",
    "partial_search": f"{_P}, {_SEARCH} select query_id, layout_id, array_to_string(nb, ' ') as neighbours, candidates, touched from found",
    "partial_fallback_summary": f"{_P}, {_SEARCH}, k as (select query_id, list(vec_id) as full from (select query_id, vec_id, row_number() over (partition by query_id order by round(list_distance(q, v), 9), vec_id) as r from qs, base) where r <= 10 group by 1), u as (select layout_id, touched or len(nb) < 10 as fb, case when touched or len(nb) < 10 then 1.0 else len(list_intersect(nb, k.full)) / len(k.full)::double end as rc from found join k using (query_id)) select layout_id as window_id, count(*) as query_count, count(*) filter (fb) as fallback_count, round(avg(rc), 6) + 0.0 as mean_recall from u group by 1",
    "dis_block_meta": f"{_DIS} select block_id, round(dmin, 6) + 0.0 as dmin, round(dmax, 6) + 0.0 as dmax, size from metas",
    "dis_read_fraction": f"{_DIS}, rad as (select avg(d) as r from (select a.vec_id, min(list_distance(a.v, b.v)) as d from base a, base b where a.vec_id <> b.vec_id group by 1)), aq as (select query_id, round(list_distance(q, c), 9) as d from qs, c) select query_id, count(dmin) as blocks, round(coalesce(sum(size), 0) / (select count(*) from base), 6) + 0.0 as fraction from aq cross join rad left join metas on dmax >= greatest(0.0, d - r) and dmin <= d + r group by query_id",
    "layout_families_proxy": f"{_FAMILIES} select window_id, candidate_id, layout_label, round(query_cost, 6) + 0.0 as query_cost, round(movement_cost, 6) + 0.0 as movement_cost from fam",
    "switch_greedy": f"{_GREEDY} select * from events",
    "switch_sticky": f"{_STICKY} select * from events",
    "replay_summary": f"{_STICKY} select round(sum(query_cost), 6) as total_query_cost, round(sum(movement_cost), 6) as total_movement_cost, round(sum(query_cost + movement_cost), 6) as total_cost, count(*) filter (switched) as switch_count, count(*) as window_count from events",
    "schedule_tables": f"select query_id // {WINDOW} as window_id, 'demo_window_' || (query_id // {WINDOW}) as layout, 'demo_window_' || (query_id // {WINDOW}) || '_ivfflat' as table_name from (select vec_id // 10 as query_id from embeddings where vec_id % 10 = 0) group by query_id // {WINDOW}",
    "wfa_trace": f"with recursive {_COSTS}, walk as (select window_id, list_transform(c, lambda x, i: x + case when i = 1 then 0.0 else 50.0 end) as o from piv where window_id = (select lo from ends) union all select piv.window_id, list_transform(c, lambda x, i: x + least(o[i], list_min(o) + 50.0)) from walk join piv on piv.window_id = walk.window_id + 1), un as (select window_id, cast(generate_subscripts(o, 1) - 1 as bigint) as state, unnest(o) as work from walk) select window_id, state, round(work, 6) + 0.0 as work, row_number() over (partition by window_id order by round(work, 9), state) = 1 as best from un",
    "regret_trace": f"with recursive {_COSTS}, walk as (select lo - 1 as window_id, 0::bigint as state, [0.0, 0.0, 0.0, 0.0]::double[] as t, false as switched from ends union all "
    "select window_id, coalesce(f, cur) as state, case when f is null then list_transform(t, lambda x, i: x + c[i]) else [0.0, 0.0, 0.0, 0.0]::double[] end as t, f is not null as switched from "
    "(select piv.window_id, walk.state as cur, t, c, list_filter(range(4), lambda s: s <> walk.state and t[walk.state + 1] + case when walk.state < s then c[walk.state + 1] else 0 end - t[s + 1] - c[s + 1] >= 100.0)[1] as f from walk join piv on piv.window_id = walk.window_id + 1)) "
    "select window_id, state, switched from walk where window_id >= (select lo from ends)",
    "cost_profile_distance": f"{_P}, {_GAPS}, {_PROFILES} select a.layout_id, round(avg(abs(a.cost - b.cost)), 6) + 0.0 as distance from prof a join prof b on a.query_id = b.query_id and b.layout_id = a.layout_id + 1 group by 1",
    "knn_single_topk": f"with {BASE}, {QUERIES_CTE} select vec_id, round(list_distance(q, v), 6) + 0.0 as distance from base, qs where query_id = 0 order by round(list_distance(q, v), 9), vec_id limit 10",
    "knn_ground_truth_recall": f"with {BASE}, {QUERIES_CTE}, t as (select query_id, vec_id from (select query_id, vec_id, row_number() over (partition by query_id order by round(list_distance(q, v), 9), vec_id) as r from qs, base) where r <= 10), h as (select query_id, vec_id from (select query_id, vec_id, row_number() over (partition by query_id order by round(list_distance(q, v), 9), vec_id) as r from qs, base where vec_id % 2 = 0) where r <= 10) select t.query_id, count(h.vec_id) as hits, round(count(h.vec_id) / 10.0, 6) as recall from t left join h on t.query_id = h.query_id and t.vec_id = h.vec_id group by 1",
    "ivf_probe_knn": f"with {BASE}, {QUERIES_CTE}, {CENTRES}, {NEAREST}, pr as (select query_id, q, cid from (select query_id, q, cid, row_number() over (partition by query_id order by round(list_distance(q, c), 9), cid) as r from qs, cent) where r <= 2), d as (select query_id, vec_id, list_distance(q, v) as distance from pr join near using (cid)), r as (select *, row_number() over (partition by query_id order by round(distance, 9), vec_id) as rank from d) select query_id, cast(rank as bigint) as rank, vec_id, round(distance, 6) + 0.0 as distance from r where rank <= 10",
}
# base, hot, balanced in this order; counters are lists of three
ORACLES["switch_counter"] = (
    f"{_FAMILIES.replace('with ', 'with recursive ', 1)}, opt as (select window_id, list(query_cost order by ord) as c, list(candidate_id order by ord) as ids, list(layout_label order by ord) as labs from fam group by 1), "
    "walk as (select -1::bigint as window_id, 0 as cur, [0.0, 0.0, 0.0]::double[] as t, 0 as prev union all "
    "select window_id, case when window_id = 0 then 0 else nxt end, case when window_id > 0 and nxt <> cur then list_transform(t2, lambda x, i: case when i = cur + 1 then 0.0 else x end) else t2 end, cur from "
    "(select *, case when t2[cur + 1] <= 20.0 then cur when list_sum(wt) > 0 then list_filter([0, 1, 2], lambda i: list_sum(wt[1:i + 1]) >= u * list_sum(wt))[1] "
    "else list_sort(list_transform([0, 1, 2], lambda i: {'t': t2[i + 1], 'n': ids[i + 1], 'i': i}))[1].i end as nxt from "
    "(select *, list_transform(t2, lambda x: greatest(0.0, (20.0 - x) / 20.0)) as wt, (((window_id + 1) * 2654435761 + 3 * 40503) % 1000003 + 1) / 1000005.0 as u from "
    "(select opt.window_id, walk.cur, ids, list_transform(walk.t, lambda x, i: x + c[i]) as t2 from walk join opt on opt.window_id = walk.window_id + 1)))) "
    "select window_id, ids[cur + 1] as chosen_candidate_id, labs[cur + 1] as layout_label, round(c[cur + 1], 6) + 0.0 as query_cost, case when window_id > 0 and cur <> prev then 20.0 else 0.0 end as movement_cost, window_id > 0 and cur <> prev as switched from walk join opt using (window_id)"
)

_U = "(({id} * 2654435761 + {seed} * 40503) % 1000003 + 1) / 1000005.0"
_FAM_ROWS = _FAMILIES[: _FAMILIES.index("kinds as")].rstrip(" ,")
_MARKOV = f"w as (select 0::bigint as query_id, 0::bigint as template union all select query_id + 1, case when {_U.format(id='(query_id + 1)', seed=7)} < 0.6 then template else (template + 1 + cast(floor({_U.format(id='(query_id + 1)', seed=8)} * 4) as bigint)) % 5 end from w where query_id < 199)"
ORACLES |= {
    "dis_partial_cost": f"{_DIS}, rad as (select avg(d) as r from (select a.vec_id, min(list_distance(a.v, b.v)) as d from base a, base b where a.vec_id <> b.vec_id group by 1)), e as (select cast(floor(0.8 * (select count(*) from metas)) as bigint) as p), "
    "aq as (select query_id, round(list_distance(q, c), 9) as d, r, p, round(list_distance(q, c), 9) + r <= (select dmax from metas where block_id = p - 1) as partial from qs, c, rad, e) "
    "select query_id, partial, count(dmin) as blocks, round(coalesce(sum(size), 0) / (select count(*) from base), 6) + 0.0 as fraction from aq left join metas on dmax >= greatest(0.0, d - r) and dmin <= d + r and (not partial or block_id <= p - 2) group by query_id, partial",
    "materialised_families": f"{_FAM_ROWS} select window_id, 'window' || window_id || '_qso_full' as candidate_id, 'qso_full' as layout_label, round(greatest(1.0::double, n * (1 + dispersion) * 0.78), 6) + 0.0 as query_cost, round(greatest(1, hot_count) * 0.3, 6) + 0.0 as movement_cost from disp join overlap using (window_id)",
    "running_state_costs": f"with {_COSTS} select window_id, state, round(cost, 6) + 0.0 as cost, round(sum(cost) over (partition by state order by window_id rows unbounded preceding), 6) + 0.0 as total from costs",
    "random_sets": f"with b as (select value, row_number() over (order by value) - 1 as p from (select distinct p_brand as value from part)), d as (select query_id, value, row_number() over (partition by query_id order by {_U.format(id='(query_id * 1000 + p)', seed=9)}, p) as r from (select unnest(range(20)) as query_id), b) select query_id, string_agg(value, ',' order by value) as \"values\" from d where r <= 3 group by 1",
    "random_spans": f"with e as (select min(cast(o_orderdate as date)) as a, max(cast(o_orderdate as date)) as b from orders), d as (select query_id, a + cast(floor({_U.format(id='query_id', seed=4)} * (b - a + 1)) as int) as lo from (select unnest(range(20)) as query_id), e) select query_id, strftime(lo, '%Y-%m-%d') as lo, strftime(lo + 30, '%Y-%m-%d') as hi from d",
    "template_workload": f"with recursive {_MARKOV}, e as (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem), r as (select i, lo + {_U.format(id='i', seed=3)} * (hi - lo) * 0.8 as a, (hi - lo) * 0.2 as s from (select unnest(range(30)) as i), e) select query_id, template, round(a, 6) + 0.0 as lo, round(a + s, 6) + 0.0 as hi from w join r on i = (query_id * 7 + template) % 30",
    "resampled_rows": f"with {BASE}, n as (select count(*) as n, avg(v[1]) as m from base), d as (select row_id, cast(floor({_U.format(id='row_id', seed=6)} * n) as bigint) as vec_id, m from (select unnest(range(300)) as row_id), n) select row_id, round(m, 6) + 0.0 as x0, round(v[3], 6) + 0.0 as x2, round(v[6], 6) + 0.0 as x5 from d join base using (vec_id)",
    "sampled_files": f"select o_orderkey, file from (select o_orderkey, o_orderstatus as file, row_number() over (partition by o_orderstatus order by {_U.format(id='o_orderkey', seed=2)}, o_orderkey) as r, count(*) over (partition by o_orderstatus) as n from orders) where r <= least(greatest(100, floor(n * 0.05)), n)",
    "neighbour_samples": f"with {BASE}, {QUERIES_CTE}, n as (select query_id, vec_id, row_number() over (partition by query_id order by round(list_distance(q, v), 9), vec_id) as r, [1, 5, 10][cast(floor({_U.format(id='query_id', seed=8)} * 3) as int) + 1]::bigint as k from qs, base) select query_id, k, vec_id from n where r <= k",
}
