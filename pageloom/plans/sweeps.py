"""Queries over cuts at every value, encoded columns and boxes of the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import columns as C
from pageloom.functions import vectors as V
from pageloom.operators import predicates as P
from pageloom.operators import sweeps
from pageloom.sources.tables import table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]
QUERY_BOXES = [{"l_quantity": (10.0, 20.0)}, {"l_discount": (None, 0.03), "l_quantity": (40.0, None)}, {"l_extendedprice": (None, 20000.0)}]
FLAG_SETS = [["A"], ["N"], ["A", "R"]]
FLAG_QUERIES = [{"l_returnflag": ["A"]}, {"l_returnflag": ["N", "R"], "l_quantity": (10.0, 20.0)}, {"l_discount": (None, 0.03)}]
LEAST = 200


def sweep_boxes(spark, root):
    return sweeps.boxes(table(spark, root, "lineitem"), "l_quantity", NUMBERS)


def sweep_distinct(spark, root):
    return sweeps.distinct_counts(table(spark, root, "lineitem"), "l_quantity", "l_suppkey")


def sweep_cut_costs(spark, root):
    found = sweeps.cut_costs(table(spark, root, "lineitem"), "l_quantity", NUMBERS, QUERY_BOXES, LEAST)
    return found.withColumn("cost", V.round6(F.col("cost")))


def sweep_best_cut(spark, root):
    found = sweeps.best_cut(table(spark, root, "lineitem"), ["l_quantity", "l_discount"], [{"l_quantity": (10.0, 20.0)}, {"l_discount": (None, 0.03)}], LEAST)
    return found.withColumn("cost", V.round6(F.col("cost")))


def category_cuts(spark, root):
    found = sweeps.category_costs(table(spark, root, "lineitem"), "l_returnflag", FLAG_SETS, NUMBERS, FLAG_QUERIES)
    return found.withColumn("cost", V.round6(F.col("cost")))


def capped_cuts(spark, root):
    cuts = table(spark, root, "lineitem").select(F.col("l_returnflag").alias("column"), F.col("l_quantity").alias("cut")).distinct()
    return sweeps.thinned(cuts, "column", (F.col("cut").cast("long") * 2654435761) % 4294967296, 10)


def hash_columns(spark, root):
    rows = C.scaled(table(spark, root, "part"), "p_retailprice", 8, "price")
    rows = C.rank_encoded(rows, "p_brand", "brand")
    return rows.select("p_partkey", "price", "brand", C.binary_text(F.col("price"), 8).alias("bits"))


def moved_dates(spark, root):
    d = F.col("o_orderdate").cast("date")
    moved = C.moved_date(d, years=1, months=-2, days=10)
    return table(spark, root, "orders").select("o_orderkey", F.date_format(moved, "yyyy-MM-dd").alias("moved"))


def zone_map_dates(spark, root):
    rows = table(spark, root, "orders").select((F.col("o_orderkey") % 7).alias("bid"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderstatus").alias("s"))
    found = P.zone_map(rows, "bid", ["d"], ["s"])
    return found.select("bid", "size", F.date_format("d_lo", "yyyy-MM-dd").alias("d_lo"), F.date_format("d_hi", "yyyy-MM-dd").alias("d_hi"), F.array_join("s_set", ",").alias("s"))


def promoted_boxes(spark, root):
    """A category with more values than the limit is a range of hash buckets instead of a set."""
    rows = table(spark, root, "lineitem").select((F.col("l_orderkey") % 5).alias("bid"), "l_returnflag", F.col("l_suppkey").cast("string").alias("supp"))
    found = P.category_boxes(rows, "bid", ["l_returnflag", "supp"], limit=5, buckets=64)
    return found.select("bid", "column", "kind", F.array_join("values", ",").alias("values"), "lo", "hi")


def merged_sets(spark, root):
    rows = table(spark, root, "lineitem").withColumn("bid", F.floor(F.col("l_quantity") / 5).cast("long"))
    parts = [P.zone_map(rows.where(f"l_orderkey % 2 = {i}"), "bid", ["l_discount"], ["l_returnflag"]) for i in (0, 1)]
    found = P.merge_zone_maps(*parts, "bid", ["l_discount"], ["l_returnflag"])
    return found.withColumn("flags", F.array_join("l_returnflag_set", ",")).drop("l_returnflag_set")


def routed_rows(spark, root):
    """Rows to the leaves of a tree that was written down and built again."""
    first = P.Node(0, 0, {}, ("l_quantity", 20.0), P.Node(1, 0, {}), P.Node(2, 0, {}, ("l_discount", 0.05), P.Node(3, 0, {}), P.Node(4, 0, {})))
    tree = P.Node.from_dict(first.to_dict())
    return table(spark, root, "lineitem").groupBy(tree.label().cast("long").alias("leaf")).agg(F.count("*").alias("n"), F.max("l_quantity").alias("top"))


QUERIES = {f.__name__: f for f in (sweep_boxes, sweep_distinct, sweep_cut_costs, sweep_best_cut, category_cuts, capped_cuts, hash_columns, moved_dates, zone_map_dates, promoted_boxes, merged_sets, routed_rows)}


def _box_sql(column: str, others: list[str], name: str) -> str:
    """{name}: sizes and boxes of both sides of every cut of a column, by comparing every value with every row's value."""
    sides = {"b": f"r.{column} <= v.value", "a": f"r.{column} > v.value"}
    cols = ", ".join(f"{fn}(r.{c}) filter ({where}) as {c}_{s}{e}" for c in others for s, where in sides.items() for e, fn in (("lo", "min"), ("hi", "max")))
    return f"{name} as (select v.value, count(*) filter ({sides['b']}) as below, count(*) filter ({sides['a']}) as above, {cols} from (select distinct {column} as value from lineitem) v, lineitem r group by v.value)"


def _meets(q: dict, side: str) -> str:
    parts = [f"{c}_{side}hi >= {lo}" for c, (lo, _) in q.items() if lo is not None] + [f"{c}_{side}lo <= {hi}" for c, (_, hi) in q.items() if hi is not None]
    return f"coalesce({' and '.join(parts)}, false)"


def _cost_sql(queries: list[dict]) -> str:
    return "(" + " + ".join(f"case when {_meets(q, 'b')} then below else 0 end + case when {_meets(q, 'a')} then above else 0 end" for q in queries) + f") / ((below + above) * {len(queries)}.0)"


def _category_sql() -> str:
    out = []
    for i, values in enumerate(FLAG_SETS):
        hit = f"l_returnflag in ({', '.join(repr(v) for v in values)})"
        cols = ", ".join(f"{fn}({c}) filter ({where}) as {c}_{s}{e}" for c in NUMBERS for s, where in (("b", hit), ("a", f"not {hit}")) for e, fn in (("lo", "min"), ("hi", "max")))
        read = []
        for q in FLAG_QUERIES:
            rest = {c: v for c, v in q.items() if c != "l_returnflag"}
            for side, size in (("b", "inside"), ("a", "outside")):
                meets = _meets(rest, side) if rest else "true"
                flags = set(q.get("l_returnflag", ["A", "N", "R"]))
                possible = flags & set(values) if side == "b" else flags - set(values)
                read.append(f"case when {meets} and {str(bool(possible)).lower()} then {size} else 0 end")
        out.append(f"select {i} as set_id, inside, outside, round(({' + '.join(read)}) / ((inside + outside) * {len(FLAG_QUERIES)}.0), 6) + 0.0 as cost from (select count(*) filter ({hit}) as inside, count(*) filter (not {hit}) as outside, {cols} from lineitem)")
    return " union all ".join(out)


_BEST = [{"l_quantity": (10.0, 20.0)}, {"l_discount": (None, 0.03)}]
ORACLES = {
    "sweep_boxes": f"with {_box_sql('l_quantity', NUMBERS, 'x')} select value, below, above, " + ", ".join(f"{c}_{e} as {c}_{e}" for c in NUMBERS for e in ("blo", "bhi", "alo", "ahi")) + " from x",
    "sweep_distinct": "select v.value, count(distinct l_suppkey) filter (l_quantity <= v.value) as below, count(distinct l_suppkey) filter (l_quantity > v.value) as above from (select distinct l_quantity as value from lineitem) v, lineitem group by v.value",
    "sweep_cut_costs": f"with {_box_sql('l_quantity', NUMBERS, 'x')} select value, below, above, round({_cost_sql(QUERY_BOXES)}, 6) + 0.0 as cost from x where below >= {LEAST} and above >= {LEAST}",
    "sweep_best_cut": f"with {_box_sql('l_quantity', ['l_quantity', 'l_discount'], 'x')}, {_box_sql('l_discount', ['l_quantity', 'l_discount'], 'y')} "
    + " union all ".join(f"(select '{c}' as column, value, round({_cost_sql(_BEST)}, 6) + 0.0 as cost from {t} where below >= {LEAST} and above >= {LEAST} order by round({_cost_sql(_BEST)}, 9), value limit 1)" for c, t in (("l_quantity", "x"), ("l_discount", "y"))),
    "category_cuts": _category_sql(),
    "capped_cuts": "select * exclude (r) from (select *, row_number() over (partition by \"column\" order by (cast(cut as bigint) * 2654435761) % 4294967296) as r from (select distinct l_returnflag as \"column\", l_quantity as cut from lineitem)) where r <= 10",
    "hash_columns": "select p_partkey, cast(floor((p_retailprice - lo) / (hi - lo) * 255) as bigint) as price, cast(dense_rank() over (order by p_brand) - 1 as bigint) as brand, lpad(bin(cast(floor((p_retailprice - lo) / (hi - lo) * 255) as bigint)), 8, '0') as bits from part, (select min(p_retailprice) as lo, max(p_retailprice) as hi from part)",
    "moved_dates": "select o_orderkey, strftime(cast(o_orderdate as date) + interval 10 month + interval 10 day, '%Y-%m-%d') as moved from orders",
    "zone_map_dates": "select o_orderkey % 7 as bid, count(*) as size, strftime(min(cast(o_orderdate as date)), '%Y-%m-%d') as d_lo, strftime(max(cast(o_orderdate as date)), '%Y-%m-%d') as d_hi, array_to_string(list_sort(list(distinct o_orderstatus)), ',') as s from orders group by 1",
    "promoted_boxes": "with r as (select l_orderkey % 5 as bid, unnest([{'c': 'l_returnflag', 'v': l_returnflag}, {'c': 'supp', 'v': cast(l_suppkey as varchar)}]) as p from lineitem), d as (select distinct bid, p.c as c, p.v as v from r), h as (select *, cast(('0x' || right(md5(v), 2)) as bigint) % 64 as h from d) "
    "select bid, c as \"column\", case when count(*) > 5 then 'range' else 'set' end as kind, case when count(*) > 5 then null else array_to_string(list_sort(list(v)), ',') end as \"values\", case when count(*) > 5 then min(h) end as lo, case when count(*) > 5 then max(h) end as hi from h group by bid, c",
    "merged_sets": "select cast(floor(l_quantity / 5) as bigint) as bid, count(*) as size, min(l_discount) as l_discount_lo, max(l_discount) as l_discount_hi, array_to_string(list_sort(list(distinct l_returnflag)), ',') as flags from lineitem group by 1",
    "routed_rows": "select case when l_quantity > 20 then case when l_discount > 0.05 then 4 else 3 end else 1 end::bigint as leaf, count(*) as n, max(l_quantity) as top from lineitem group by 1",
}
