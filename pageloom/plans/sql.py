"""Common table expressions that the SQL twins share."""

from __future__ import annotations

BASE = "base as (select vec_id, label, embedding::double[] as v from embeddings)"
QUERIES_CTE = "qs as (select vec_id // 10 as query_id, v as q from base where vec_id % 10 = 0)"
CENTRES = "cent as (select label as cid, list(a order by i) as c from (select label, i, avg(x) as a from (select label, generate_subscripts(v, 1) as i, unnest(v) as x from base) group by label, i) group by label)"
QMEAN = "qm as (select list(a order by i) as m from (select i, avg(x) as a from (select generate_subscripts(q, 1) as i, unnest(q) as x from qs) group by i))"
QBAR = f"{QMEAN}, qbar as (select list_transform(m, lambda x: x / n) as qbar from (select m, sqrt(list_inner_product(m, m)) as n from qm))"
NEAREST = "near as (select vec_id, v, cid, c, list_distance(v, c) as dist from (select *, row_number() over (partition by vec_id order by round(list_distance(v, c), 9), cid) as r from base, cent) where r = 1)"


def farthest(name: str, rows: str, key: str, vector: str, low: int, high: int) -> str:
    """Farthest points of a table: {name}(aid, a), from the smallest key on, ties to the smaller key. Needs `with recursive`."""
    n = f"(select least(count(*), greatest({low}, least({high}, cast(ceil(4 * ln(greatest(count(*), 2))) as bigint)))) from {rows})"
    first = f"(select {vector} from {rows} order by {key} limit 1)"
    return (
        f"{name}_walk as (select 1::bigint as step, {key} as aid, {vector} as a, list_distance({vector}, {first}) as far, {key} = (select min({key}) from {rows}) as taken from {rows} "
        f"union all select w.step + 1, w.aid, w.a, least(w.far, list_distance(w.a, p.a)), w.taken or w.aid = p.aid from {name}_walk w, (select aid, a from {name}_walk order by far desc, aid limit 1) p where w.step < {n}), "
        f"{name} as (select aid, a from {name}_walk where taken and step = {n})"
    )


def gravity_to(name: str, rows: str, k: int, anchors: str = "anc", own: bool = False) -> str:
    """{name}(vec_id, v): {rows} pulled by their k nearest anchors; own takes the transform among the rows themselves."""
    near = f"{name}_n as (select vec_id, v, a, list_distance(v, a) as d, row_number() over (partition by vec_id order by list_distance(v, a), aid) as r from {rows}, {anchors})"
    if own:
        return (
            f"{near}, {name}_1 as (select vec_id, d as d1 from {name}_n where r = 2), {name}_dc as (select avg(d1) as dc from {name}_1), {name}_0 as (select vec_id, generate_subscripts(a, 1) as i, unnest(a) as x from {name}_n where r = 1), "
            f"{name}_f as (select vec_id, generate_subscripts(a, 1) as i, unnest(a) as a, d from {name}_n where r between 2 and {k + 1}), "
            f"{name}_x as (select z.vec_id, z.i, any_value(z.x) + 0.3 * (1 + sum(dc * d1 / greatest(d * d, 1e-8) * (f.a - z.x))) as x from {name}_0 z join {name}_f f using (vec_id, i) join {name}_1 using (vec_id), {name}_dc group by z.vec_id, z.i), "
            f"{name} as (select vec_id, list(x order by i) as v from {name}_x group by vec_id)"
        )
    return (
        f"{near}, {name}_dc as (select avg(d) as dc from (select list_distance(x.a, y.a) as d from {anchors} x, {anchors} y) where d > 0), {name}_0 as (select vec_id, generate_subscripts(v, 1) as i, unnest(v) as x from {rows}), "
        f"{name}_f as (select vec_id, generate_subscripts(a, 1) as i, unnest(a) as a, d from {name}_n where r <= {k}), "
        f"{name}_x as (select z.vec_id, z.i, any_value(z.x) + 0.3 * (1 + sum(dc / greatest(d * d, 1e-8) * (f.a - z.x))) as x from {name}_0 z join {name}_f f using (vec_id, i), {name}_dc group by z.vec_id, z.i), "
        f"{name} as (select vec_id, list(x order by i) as v from {name}_x group by vec_id)"
    )


def centroids_of(rows: str) -> str:
    """cent(cid, c): label means of a table of (vec_id, v)."""
    return f"cent as (select label as cid, list(a order by i) as c from (select label, i, avg(x) as a from (select t.vec_id, generate_subscripts(t.v, 1) as i, unnest(t.v) as x from {rows} t) join (select vec_id, label from base) using (vec_id) group by label, i) group by label)"


def numbered(score: str, key: str) -> str:
    """o(vec_id, pos): near by its cluster's score, then by key."""
    return f"o as (select vec_id, cast(row_number() over (order by round({score}, 9), cid, round({key}, 9), vec_id) - 1 as bigint) as pos from near join sums using (cid))"


def placed_by(rows: str, where: str = "") -> str:
    """o(vec_id, pos): rows by their nearest centre's summed distances, then by distance to it."""
    return (
        f"near as (select vec_id, v, cid, c, list_distance(v, c) as dist from (select *, row_number() over (partition by vec_id order by round(list_distance(v, c), 9), cid) as r from (select * from {rows} {where}) t, cent) where r = 1), "
        f"sums as (select a.cid, sum(list_distance(a.c, b.c)) as total from cent a, cent b group by a.cid), {numbered('total', 'dist')}"
    )
