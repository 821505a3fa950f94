"""Queries over predicates, zone maps and partitions of the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import vectors as V
from pageloom.operators import predicates as P
from pageloom.sources import partitions
from pageloom.sources.scratch import path_for
from pageloom.sources.tables import table

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]
WORKLOAD = [
    P.Leaf("l_quantity", "between", (10.0, 20.0)),
    P.Tree(P.Leaf("l_discount", "le", (0.03,)), P.Leaf("l_quantity", "gt", (40.0,)), True),
    P.Tree(P.Leaf("l_returnflag", "in", ("R",)), P.Leaf("l_extendedprice", "between", (None, 20000.0)), True),
    P.build([P.Leaf("l_quantity", "gt", (45.0,)), P.Leaf("l_returnflag", "in", ("A", "N")), P.Leaf("l_discount", "between", (0.05, 0.07))], [False, True]),
]


def _lines(spark, root):
    """lineitem with bid: bands of five pieces."""
    return table(spark, root, "lineitem").withColumn("bid", F.floor(F.col("l_quantity") / 5).cast("long"))


def _zones(spark, root):
    return P.zone_map(_lines(spark, root), "bid", [*COLUMNS, "l_returnflag"], ["l_returnflag"])


def zone_map_lineitem(spark, root):
    rows = _zones(spark, root)
    return rows.withColumn("flags", F.array_join("l_returnflag_set", ",")).drop("l_returnflag_set")


def zone_map_merged(spark, root):
    rows = _lines(spark, root)
    odd, even = rows.where("l_orderkey % 2 = 1"), rows.where("l_orderkey % 2 = 0")
    return P.merge_zone_maps(P.zone_map(odd, "bid", COLUMNS), P.zone_map(even, "bid", COLUMNS), "bid", COLUMNS)


def predicate_rows(spark, root):
    counts = table(spark, root, "lineitem").agg(*[F.count_if(p.rows()).alias(f"q{i}") for i, p in enumerate(WORKLOAD)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("query_id"), F.col(f"q{i}").alias("rows")) for i in range(len(WORKLOAD))])).alias("r")).select("r.*")


def predicate_skip_cost(spark, root):
    n = table(spark, root, "lineitem").count()
    return P.read_fractions(_zones(spark, root), WORKLOAD, n).withColumn("fraction", V.round6(F.col("fraction")))


def split_candidates(spark, root):
    return P.candidate_cuts(table(spark, root, "lineitem"), WORKLOAD, 500)


def median_split(spark, root):
    rows = table(spark, root, "lineitem")
    return spark.createDataFrame([(c, float(P.median_cut(rows, c))) for c in COLUMNS], "column string, cut double")


def top_columns(spark, root):
    return spark.createDataFrame(P.top_columns(WORKLOAD, {"l_returnflag": 0.5}), "column string, weight double")


def partition_pruned_sql(spark, root):
    path = path_for(spark, "lineitem-by-band")
    partitions.write_partitions(_lines(spark, root), path)
    parts = P.matching_parts(_zones(spark, root), "bid", WORKLOAD[1])
    text = f"select l_returnflag, count(*) as n, round(sum(l_extendedprice), 2) as price from tbl where {WORKLOAD[1].sql()} group by l_returnflag"
    return partitions.run_sql(spark, path, text, parts)


def _tree(spark, root):
    rows = table(spark, root, "lineitem")
    queries = [{"l_quantity": (10.0, 20.0)}, {"l_discount": (None, 0.03), "l_quantity": (40.0, None)}, {"l_extendedprice": (None, 20000.0)}]
    cuts = [("l_quantity", 9.0), ("l_quantity", 20.0), ("l_quantity", 39.0), ("l_discount", 0.03), ("l_extendedprice", 20000.0)]
    return rows, P.grow_tree(rows, COLUMNS, cuts, queries, 6)


def qd_tree_leaves(spark, root):
    rows, tree = _tree(spark, root)
    return P.zone_map(rows.withColumn("bid", tree.label()), "bid", COLUMNS)


def categorical_cuts(spark, root):
    return P.categorical_cuts(table(spark, root, "lineitem"), [*WORKLOAD, P.Leaf("l_linestatus", "in", ("O",))], 500)


def qd_tree_fallback(spark, root):
    """No cut of the workload helps, so nodes are cut at medians: sizes and boxes of the leaves."""
    rows = table(spark, root, "lineitem")
    tree = P.grow_tree(rows, ["l_quantity"], [("l_quantity", 1000.0)], [{"l_quantity": (0.0, 100.0)}], 2, fallback=True)
    return P.zone_map(rows.withColumn("bid", tree.label().cast("long")), "bid", ["l_quantity"])


def replay_reorganised(spark, root):
    """(layout, query_id, parts, rows): the table written anew for each layout, then every query over the partitions it can match in."""
    lines, out = table(spark, root, "lineitem"), None
    for name, label in (("bands", F.floor(F.col("l_quantity") / 5)), ("prices", F.floor(F.col("l_extendedprice") / 10000))):
        rows, path = lines.withColumn("bid", label.cast("long")), path_for(spark, f"replay-{name}")
        partitions.write_partitions(rows, path)
        zones = P.zone_map(rows, "bid", [*COLUMNS, "l_returnflag"], ["l_returnflag"])
        for i, p in enumerate(WORKLOAD):
            parts = P.matching_parts(zones, "bid", p)
            found = partitions.read_partitions(spark, path, parts).where(p.rows()).agg(F.count("*").alias("rows"))
            one = found.select(F.lit(name).alias("layout"), F.lit(i).cast("long").alias("query_id"), F.lit(len(parts)).cast("long").alias("parts"), "rows")
            out = one if out is None else out.unionByName(one)
    return out


def hash_partitions(spark, root):
    part = table(spark, root, "part")
    return P.hash_partitions(part, "p_partkey", F.col("p_brand"), F.col("p_size"), 16)


QUERIES = {f.__name__: f for f in (zone_map_lineitem, zone_map_merged, predicate_rows, predicate_skip_cost, split_candidates, median_split, top_columns, partition_pruned_sql, qd_tree_leaves, qd_tree_fallback, categorical_cuts, replay_reorganised, hash_partitions)}
_Z = "z as (select cast(floor(l_quantity / 5) as bigint) as bid, count(*) as size, " + ", ".join(f"min({c}) as {c}_lo, max({c}) as {c}_hi" for c in [*COLUMNS, "l_returnflag"]) + ", list_sort(list(distinct l_returnflag)) as s from lineitem group by 1)"
_TOUCH = [
    "l_quantity_hi >= 10 and l_quantity_lo <= 20",
    "l_discount_lo <= 0.03 and l_quantity_hi > 40",
    "list_contains(s, 'R') and l_extendedprice_lo <= 20000",
    "(l_quantity_hi > 45 or list_has_any(s, ['A', 'N'])) and l_discount_hi >= 0.05 and l_discount_lo <= 0.07",
]
_CUTS = [(c, x) for c, x in sorted({(leaf.column, x) for p in WORKLOAD for leaf in p.leaves() if leaf.kind != "in" for x in leaf.values if x is not None})]
ORACLES = {
    "zone_map_lineitem": f"with {_Z} select * exclude (s), array_to_string(s, ',') as flags from z",
    "zone_map_merged": "select cast(floor(l_quantity / 5) as bigint) as bid, count(*) as size, " + ", ".join(f"min({c}) as {c}_lo, max({c}) as {c}_hi" for c in COLUMNS) + " from lineitem group by 1",
    "predicate_rows": " union all ".join(f"select cast({i} as bigint) as query_id, count(*) as rows from lineitem where {p.sql()}" for i, p in enumerate(WORKLOAD)),
    "predicate_skip_cost": f"with {_Z}, n as (select count(*) as n from lineitem) " + " union all ".join(f"select cast({i} as bigint) as query_id, count(*) as parts, round(sum(size) / any_value(n), 6) + 0.0 as fraction from z, n where {t}" for i, t in enumerate(_TOUCH)),
    "split_candidates": "select * from (" + " union all ".join(f"select '{c}' as column, {float(x)}::double as cut, count(*) filter ({c} > {x}) as above, count(*) filter (not {c} > {x}) as below from lineitem" for c, x in _CUTS) + ") where above >= 500 and below >= 500",
    "median_split": " union all ".join(f"select '{c}' as column, {c} as cut from (select {c} from lineitem order by {c} limit 1 offset (select count(*) // 2 from lineitem))" for c in COLUMNS),
    "top_columns": "select * from (values ('l_quantity', 3.0::double), ('l_returnflag', 2.5::double)) t(\"column\", weight)",
    "partition_pruned_sql": f"select l_returnflag, count(*) as n, round(sum(l_extendedprice), 2) as price from lineitem where {WORKLOAD[1].sql()} group by l_returnflag",
}
_DIGITS = "cast(list_reduce(list_prepend(0::bigint, list_transform(string_split(md5({x}), ''), lambda d: cast(instr('0123456789abcdef', d) - 1 as bigint))), lambda a, d: (a * 16 + d) % 16) as bigint)"
ORACLES["hash_partitions"] = (
    f"with k as (select p_partkey as id, {_DIGITS.format(x='p_brand')} as b1, {_DIGITS.format(x='cast(p_size as varchar)')} as b2 from part), n as (select count(*) // 16 + 1 as room from part), "
    "one as (select *, row_number() over (partition by b1 order by id) as r from k), kept as (select id, b1 as bid from one, n where r <= room), used as (select bid, count(*) as c from kept group by 1), "
    "two as (select id, b2, row_number() over (partition by b2 order by id) as r2 from one, n where r > room), fit as (select two.*, r2 <= room - coalesce(c, 0) as fits from two left join used on b2 = bid, n), "
    "moved as (select id, b2 as bid from fit where fits), filled as (select bid, count(*) as c from (select * from kept union all select * from moved) group by 1), "
    "free as (select b as bid, room - coalesce(c, 0) as free from (select unnest(range(16)) as b) left join filled on b = bid, n), upto as (select bid, sum(free) over (order by bid) as hi, sum(free) over (order by bid) - free as lo from free), "
    "rest as (select id, row_number() over (order by id) - 1 as p from fit where not fits) "
    "select * from kept union all select * from moved union all select id, bid from rest join upto on p >= lo and p < hi"
)
ORACLES["categorical_cuts"] = " union all ".join(
    f"select * from (select '{c}' as column, '{','.join(v)}' as \"values\", count(*) filter ({c} in ({', '.join(repr(x) for x in v)})) as inside, count(*) filter ({c} not in ({', '.join(repr(x) for x in v)})) as outside from lineitem) where inside >= 500 and outside >= 500"
    for c, v in (("l_linestatus", ("O",)), ("l_returnflag", ("A", "N")), ("l_returnflag", ("R",)))
)
ORACLES["qd_tree_fallback"] = "with m as (select l_quantity as m from lineitem order by l_quantity limit 1 offset (select count(*) // 2 from lineitem)) select case when l_quantity > m then 2 else 1 end::bigint as bid, count(*) as size, min(l_quantity) as l_quantity_lo, max(l_quantity) as l_quantity_hi from lineitem, m group by 1"
ORACLES["replay_reorganised"] = " union all ".join(
    f"select '{name}' as layout, cast({i} as bigint) as query_id, (select count(*) from {_Z.removeprefix("z as ").replace("l_quantity / 5", by)} where {t}) as parts, (select count(*) from lineitem where {p.sql()}) as rows"
    for name, by in (("bands", "l_quantity / 5"), ("prices", "l_extendedprice / 10000"))
    for i, (t, p) in enumerate(zip(_TOUCH, WORKLOAD))
)
