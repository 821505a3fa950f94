"""Queries over experiments: recall, access, replays, budgets, and sets of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import vectors as V
from pageloom.operators import knn, orders, partial, policies, profiles, reports, workload
from pageloom.plans import workload as W
from pageloom.plans.sql import BASE, QUERIES_CTE
from pageloom.sources.tables import base_vectors, query_stream, table


def _both(spark, root):
    return base_vectors(spark, root), query_stream(spark, root)


def recall_zero_without_truth(spark, root):
    """Half of the queries have no truth: 0 for them."""
    base, queries = _both(spark, root)
    truth = knn.exact(queries.where("query_id % 2 = 0"), base, 10)
    found = knn.exact(queries, base.where("vec_id % 3 <> 0"), 10)
    return knn.recall(found, truth, 10, queries, empty=0.0).select("query_id", "hits", V.round6(F.col("recall")).alias("recall"))


def recall_one_without_truth(spark, root):
    """Half of the queries have no truth: 1 for them."""
    base, queries = _both(spark, root)
    truth = knn.exact(queries.where("query_id % 2 = 0"), base, 10)
    found = knn.exact(queries, base.where("vec_id % 3 <> 0"), 10)
    return knn.recall(found, truth, 10, queries).select("query_id", "hits", V.round6(F.col("recall")).alias("recall"))


def knn_over_pages(spark, root):
    base, queries = _both(spark, root)
    found = reports.layout_knn(queries, base, orders.scattered_order(base), 16, 10)
    return found.withColumn("distance", V.round6(F.col("distance")))


def knn_cube6(spark, root):
    """Nearest neighbours by the first six dimensions."""
    base, queries = _both(spark, root)
    near = knn.exact(queries.withColumn("q", F.slice("q", 1, 6)), base.withColumn("v", F.slice("v", 1, 6)), 10)
    return near.withColumn("distance", V.round6(F.col("distance")))


def knn_experiment(spark, root):
    base, queries = _both(spark, root)
    truth = knn.exact(queries, base, 10)
    found = reports.experiment(queries, {"whole": base, "thirds": base.where("vec_id % 3 <> 0")}, truth, [5, 10])
    return found.select("table_name", F.col("k").cast("long").alias("k"), "query_id", "ids", V.round6(F.col("recall")).alias("recall"))


def knn_experiment_summary(spark, root):
    log = knn_experiment(spark, root).withColumn("cost", F.size(F.split("ids", " ")).cast("double"))
    found = reports.by_table(log, "table_name", "cost", "recall")
    return found.withColumns({c: V.round6(F.col(c)) for c in ("total_cost", "average_cost", "average_recall")})


def replay_with_searches(spark, root):
    """Every second window on its partial layout: costs, switches, fallbacks and recall."""
    base, queries, found = W._search(spark, root)
    rows = partial.search_with_fallback(found, base, queries, W.K).withColumnRenamed("layout_id", "window_id")
    label = F.when(F.col("window_id") % 2 == 0, "partial").otherwise("base")
    events = workload.windows(query_stream(spark, root), W.WINDOW).select("window_id", label.alias("layout_label"), (F.col("query_count") * 0.5).alias("query_cost"), F.lit(1.0).alias("movement_cost"), (F.col("window_id") > 0).alias("switched"))
    total = reports.replay_totals(events, rows.select("window_id", "query_id", "fallback", "recall"))
    return total.withColumns({c: V.round6(F.col(c)) for c in ("total_query_cost", "total_movement_cost", "mean_recall")})


def label_jaccard(spark, root):
    base = base_vectors(spark, root)
    labels = base.select("vec_id", "label")
    return reports.jaccard_distance(labels, labels.withColumn("label", F.col("vec_id") % 8), "vec_id", "label").select(V.round6(F.col("distance")).alias("distance"))


def partition_budgets(spark, root):
    files = table(spark, root, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("file")).agg(F.count("*").alias("size"))
    even = reports.partition_budget(files, 40, equal=True).select("file", F.col("parts").alias("even_parts"))
    return reports.partition_budget(files, 40).join(even, "file")


def sampled_positives(spark, root):
    base, queries = _both(spark, root)
    samples = queries.select("query_id").crossJoin(F.broadcast(base.where("vec_id % 25 = 0").select("vec_id")))  # a stated sample
    return reports.positives(samples, knn.exact(queries, base, 10))


def unassigned_ids(spark, root):
    base = base_vectors(spark, root)
    return reports.unassigned(base, base.where("label % 3 <> 0"))


def layout_gather(spark, root):
    base = base_vectors(spark, root)
    return reports.in_layout_order(base, orders.scattered_order(base)).select("pos", "vec_id", V.round6(F.col("v")[0]).alias("x"))


def hot_start_rows(spark, root):
    found = reports.repeated_rows(base_vectors(spark, root).select("vec_id", "label"), "vec_id", 50, 20)
    return found.groupBy("vec_id", "label").agg(F.count("*").alias("n"), F.max("copy").cast("long").alias("last"))


def tiled_queries(spark, root):
    base, queries = _both(spark, root)
    n = queries.count()
    return reports.tiled(queries.select("query_id"), n, base.count() // 5 + 3)


def sampled_windows(spark, root):
    """Three queries of every window, by a hash of their ids, in the order of arrival."""
    rows = workload.with_window(query_stream(spark, root), W.WINDOW).select("window_id", "query_id")
    return workload.uniform_sample(rows, "query_id", 3, "window_id", seed=5)


def clustered_queries(spark, root):
    """Rounds of queries from one cluster each, moved by noise of a tenth of each dimension's spread."""
    base = base_vectors(spark, root)
    found = workload.clustered_stream(base.select("vec_id", "label", "v"), "label", rounds=4, size=15, noise=0.1, seed=11)
    return found.select("query_id", "label", "vec_id", V.round6(F.col("q")[0]).alias("x"))


def markov_workload(spark, root):
    return workload.markov_templates(spark, templates=5, length=200, stay=0.6, seed=7)


def random_predicates(spark, root):
    """Ranges of quantities, sets of flags and date spans drawn from the columns' values."""
    found = workload.random_ranges(table(spark, root, "lineitem"), "l_quantity", n=30, selectivity=0.2, seed=3)
    return found.select("query_id", V.round6(F.col("lo")).alias("lo"), V.round6(F.col("hi")).alias("hi"))


def switch_on_pool(spark, root):
    """The sticky policy over whole and pooled partial layouts."""
    return policies.greedy(_pool_families(spark, root), threshold=0.05, sticky=True).withColumns({c: V.round6(F.col(c)) for c in ("query_cost", "movement_cost")})


def layout_pool(spark, root):
    *_, found = W.cost_profiles(spark, root)
    pool = profiles.candidate_pool(found, epsilon=0.05)
    return pool.select("layout_id", "accepted", V.round6(F.col("nearest")).alias("nearest"))


def redundant_states(spark, root):
    *_, found = W.cost_profiles(spark, root)
    return profiles.redundant_pairs(found, epsilon=0.5).select("layout_id", "other_id", V.round6(F.col("distance")).alias("distance"))


def _pool_families(spark, root):
    base, queries, found = W.cost_profiles(spark, root)
    pool = profiles.candidate_pool(found, epsilon=0.05)
    windows = queries.select("query_id", F.col("layout_id").alias("window_id"))
    return profiles.pooled_families(found, windows, pool, covered=partial.covered(base.count(), W.CAPACITY, W.BETA))


def pooled_families(spark, root):
    return _pool_families(spark, root).select("window_id", "candidate_id", "layout_label", V.round6(F.col("query_cost")).alias("query_cost"), "movement_cost")


QUERIES = {
    f.__name__: f
    for f in (
        recall_zero_without_truth, recall_one_without_truth, knn_over_pages, knn_cube6, knn_experiment, knn_experiment_summary, replay_with_searches, label_jaccard, partition_budgets, sampled_positives,
        unassigned_ids, layout_gather, hot_start_rows, tiled_queries, sampled_windows, clustered_queries, markov_workload, random_predicates, layout_pool, redundant_states, pooled_families, switch_on_pool,
    )
}

_NEAR = "near as (select query_id, vec_id, d, row_number() over (partition by query_id order by round(d, 9), vec_id) as r from (select query_id, vec_id, list_distance(q, v) as d from qs, base{where}))"
_RECALL = (
    f"with {BASE}, {QUERIES_CTE}, all_near as (select query_id, vec_id, row_number() over (partition by query_id order by round(list_distance(q, v), 9), vec_id) as r from qs, base), t as (select * from all_near where r <= 10 and query_id % 2 = 0), "
    "f as (select query_id, vec_id from (select query_id, vec_id, row_number() over (partition by query_id order by r) as k from all_near where vec_id % 3 <> 0) where k <= 10) "
    "select qs.query_id, count(f.vec_id) as hits, case when count(t.vec_id) = 0 then {empty} else round(count(f.vec_id) / count(t.vec_id), 6) + 0.0 end as recall from qs left join t on t.query_id = qs.query_id left join f on f.query_id = t.query_id and f.vec_id = t.vec_id group by 1"
)
_EXPERIMENT = (
    f"with {BASE}, {QUERIES_CTE}, all_near as (select query_id, vec_id, row_number() over (partition by query_id order by round(list_distance(q, v), 9), vec_id) as r from qs, base), "
    "tabs as (select 'whole' as table_name, query_id, vec_id, r from all_near union all select 'thirds', query_id, vec_id, row_number() over (partition by query_id order by r) from all_near where vec_id % 3 <> 0), "
    "ks as (select unnest([5, 10])::bigint as k), e as (select table_name, k, t.query_id, string_agg(cast(t.vec_id as varchar), ' ' order by t.r) as ids, round(count(a.vec_id) / k, 6) + 0.0 as recall from tabs t join ks on t.r <= k left join all_near a on a.query_id = t.query_id and a.vec_id = t.vec_id and a.r <= k group by 1, 2, 3) "
)
_U = "(({id} * 2654435761 + {seed} * 40503) % 1000003 + 1) / 1000005.0"
_POOL = (
    f"{W._P.replace('with ', 'with recursive ', 1)}, {W._GAPS}, {W._PROFILES}, dist as (select a.layout_id, b.layout_id as other_id, avg(abs(a.cost - b.cost)) as d from prof a join prof b using (query_id) group by 1, 2), "
    "lay as (select layout_id, row_number() over (order by layout_id) as i from (select distinct layout_id from prof)), "
    "pool as (select 0::bigint as i, null::bigint as layout_id, []::bigint[] as kept, null::double as nearest, false as accepted union all "
    "select i, layout_id, case when nearest is null or nearest > 0.05 then list_append(kept, layout_id) else kept end, nearest, nearest is null or nearest > 0.05 from "
    "(select lay.i, lay.layout_id, pool.kept, (select min(d) from dist where dist.layout_id = lay.layout_id and list_contains(pool.kept, dist.other_id)) as nearest from pool join lay on lay.i = pool.i + 1))"
)
_POOLED = (
    f"{_POOL}, fam as (select w.window_id, 'window' || w.window_id || '_partial_' || prof.layout_id as candidate_id, 'partial_' || prof.layout_id as layout_label, avg(cost) as query_cost, any_value(cov)::double as movement_cost, prof.layout_id as p from prof join w using (query_id) join pool on pool.layout_id = prof.layout_id and accepted and prof.layout_id <= w.window_id, n group by 1, 2, 3, prof.layout_id "
    "union all select window_id, 'window' || window_id || '_base', 'base', 1.0, 0.0, -1 from (select distinct window_id from w))"
)
ORACLES = {
    "recall_zero_without_truth": _RECALL.replace("{empty}", "0.0"),
    "recall_one_without_truth": _RECALL.replace("{empty}", "1.0"),
    "knn_over_pages": f"with {BASE}, {QUERIES_CTE}, {_NEAR.format(where='')}, o as (select vec_id, (row_number() over (order by (vec_id * 2654435761) % 4294967296, vec_id) - 1) // 16 as page_id from base) select query_id, row_number() over (partition by query_id order by round(d, 9), page_id, vec_id) as rank, page_id, vec_id, round(d, 6) + 0.0 as distance, (select max(page_id) + 1 from o) as pages_read from near join o using (vec_id) where r <= 10",
    "knn_cube6": f"with {BASE}, {QUERIES_CTE}, n as (select query_id, vec_id, list_distance(q[1:6], v[1:6]) as d, row_number() over (partition by query_id order by round(list_distance(q[1:6], v[1:6]), 9), vec_id) as rank from qs, base) select query_id, rank, vec_id, round(d, 6) + 0.0 as distance from n where rank <= 10",
    "knn_experiment": f"{_EXPERIMENT} select * from e",
    "knn_experiment_summary": f"{_EXPERIMENT} select table_name, count(*) as runs, cast(sum(k) as double) as total_cost, round(avg(k), 6) + 0.0 as average_cost, round(avg(recall), 6) + 0.0 as average_recall from e group by 1",
    "replay_with_searches": f"{W._P}, {W._SEARCH}, kk as (select query_id, list(vec_id) as full from (select query_id, vec_id, row_number() over (partition by query_id order by round(list_distance(q, v), 9), vec_id) as r from qs, base) where r <= 10 group by 1), u as (select layout_id, touched or len(nb) < 10 as fb, case when touched or len(nb) < 10 then 1.0 else len(list_intersect(nb, kk.full)) / len(kk.full)::double end as rc from found join kk using (query_id)), "
    "ev as (select window_id, count(*) * 0.5 as c from w group by 1) select round(sum(c), 6) + 0.0 as total_query_cost, cast(count(*) as double) as total_movement_cost, count(*) filter (window_id > 0) as switch_count, count(*) as window_count, (select count(*) from u where layout_id % 2 = 0) as query_count, (select count(*) from u where layout_id % 2 = 0 and fb) as fallback_count, (select round(avg(rc), 6) + 0.0 from u where layout_id % 2 = 0) as mean_recall from ev",
    "label_jaccard": "with a as (select label as x, vec_id % 8 as y, count(*) as n from embeddings group by 1, 2), j as (select x, max(n / (nx + ny - n)) as j from a join (select label as x, count(*) as nx from embeddings group by 1) using (x) join (select vec_id % 8 as y, count(*) as ny from embeddings group by 1) using (y) group by x) select round(1 - avg(j), 6) + 0.0 as distance from j",
    "partition_budgets": "with f as (select l_returnflag || l_linestatus as file, count(*) as size from lineitem group by 1), c as (select count(*) as m, sum(size) as total from f), w as (select file, size / total * (40 - m) as want, 1.0 / m * (40 - m) as ew from f, c), "
    "o as (select file, cast(floor(want) as bigint) + 1 as own, cast(floor(ew) as bigint) + 1 as eo, row_number() over (order by round(want - floor(want), 9) desc, file) as p, row_number() over (order by round(ew - floor(ew), 9) desc, file) as ep from w) "
    "select file, own + case when p <= 40 - (select sum(own) from o) then 1 else 0 end as parts, eo + case when ep <= 40 - (select sum(eo) from o) then 1 else 0 end as even_parts from o",
    "sampled_positives": f"with {BASE}, {QUERIES_CTE}, {_NEAR.format(where='')} select qs.query_id, base.vec_id, n.vec_id is not null as positive from qs cross join base left join (select * from near where r <= 10) n on n.query_id = qs.query_id and n.vec_id = base.vec_id where base.vec_id % 25 = 0",
    "unassigned_ids": "select vec_id from embeddings where label % 3 = 0",
    "layout_gather": "select row_number() over (order by (vec_id * 2654435761) % 4294967296, vec_id) - 1 as pos, vec_id, round(embedding[1]::double, 6) + 0.0 as x from embeddings",
    "hot_start_rows": "select vec_id, label, case when vec_id % 50 = 0 then 21 else 1 end::bigint as n, case when vec_id % 50 = 0 then 20 else 0 end::bigint as last from embeddings",
    "tiled_queries": "with n as (select count(*) as n from embeddings where vec_id % 10 = 0), t as (select unnest(range((select count(*) // 5 + 3 from embeddings))) as t) select t as tile_id, t % n as query_id from t, n",
    "sampled_windows": f"select window_id, query_id from (select query_id // {W.WINDOW} as window_id, query_id, row_number() over (partition by query_id // {W.WINDOW} order by {_U.format(id='query_id', seed=5)}, query_id) as r from (select vec_id // 10 as query_id from embeddings where vec_id % 10 = 0)) where r <= 3",
    "clustered_queries": f"with {BASE}, x as (select vec_id, generate_subscripts(v, 1) as i, unnest(v) as x from base), s as (select stddev_samp(x) as s from x where i = 1), labs as (select label, row_number() over (order by label) - 1 as p, count(*) over () as n from (select distinct label from base)), "
    f"rounds as (select unnest(range(4)) as t), chosen as (select t, label from rounds join labs on p = cast(floor({_U.format(id='t', seed=11)} * n) as bigint)), "
    f"m as (select label, vec_id, v, row_number() over (partition by label order by vec_id) - 1 as p, count(*) over (partition by label) as n from base), "
    f"q as (select t * 15 + j as query_id, chosen.label, m.vec_id, m.v from chosen cross join (select unnest(range(15)) as j) join m on m.label = chosen.label and m.p = cast(floor({_U.format(id='(t * 15 + j)', seed=12)} * m.n) as bigint)) "
    f"select query_id, label, vec_id, round(v[1] + 0.1 * s * (2 * {_U.format(id='(query_id * 64 + 0)', seed=13)} - 1), 6) + 0.0 as x from q, s",
    "markov_workload": f"with recursive u as (select unnest(range(200)) as i), w as (select 0::bigint as query_id, 0::bigint as template union all select query_id + 1, case when {_U.format(id='(query_id + 1)', seed=7)} < 0.6 then template else (template + 1 + cast(floor({_U.format(id='(query_id + 1)', seed=8)} * 4) as bigint)) % 5 end from w where query_id < 199) select query_id, template from w",
    "random_predicates": f"with e as (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem), q as (select unnest(range(30)) as query_id), r as (select query_id, lo + {_U.format(id='query_id', seed=3)} * (hi - lo) * 0.8 as a, (hi - lo) * 0.2 as w from q, e) select query_id, round(a, 6) + 0.0 as lo, round(a + w, 6) + 0.0 as hi from r",
    "layout_pool": f"{_POOL} select layout_id, accepted, round(nearest, 6) + 0.0 as nearest from pool where i > 0",
    "redundant_states": f"{W._P}, {W._GAPS}, {W._PROFILES} select a.layout_id, b.layout_id as other_id, round(avg(abs(a.cost - b.cost)), 6) + 0.0 as distance from prof a join prof b on a.query_id = b.query_id and a.layout_id < b.layout_id group by 1, 2 having round(avg(abs(a.cost - b.cost)), 9) < 0.5",
    "pooled_families": f"{_POOLED} select window_id, candidate_id, layout_label, round(query_cost, 6) + 0.0 as query_cost, movement_cost from fam",
}
