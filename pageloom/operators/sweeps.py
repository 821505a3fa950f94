"""Cuts of a table at every value of a column: boxes on both sides, the share that queries still read, the best cut.

Rows are first reduced to one a value; running extremes go range by range, so no task holds the whole order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A query is {column: (lo, hi)} for numbers, None where open, or {column: [values]} for categories.
Query = dict[str, tuple | list]


def by_value(rows: DataFrame, column: str, numbers: list[str], categories: list[str] = ()) -> DataFrame:
    """(value, n, <c>_lo, <c>_hi): a row a different value of the column; rows without a value are left out."""
    aggs = [F.count("*").alias("n")]
    for c in [*numbers, *categories]:
        aggs += [F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi")]
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(*aggs)


def running(values: DataFrame, down: list[Column], up: list[Column], ranges: int = 64) -> DataFrame:
    """values with running aggregates: `down` over the rows up to each value, `up` over the rows above it.

    Each is (name, function, column). The order is cut into ranges by quantiles; ranges before and after a row's own
    are aggregated whole, one row a range.
    """
    parts = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = values.agg(F.array_distinct(F.percentile_approx("value", parts, F.lit(10000))).alias("cuts"))
    met = values.crossJoin(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    whole = met.groupBy("part").agg(*[fn(c).alias(name) for name, fn, c in [*down, *up]])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    outer = whole.select("part", *[fn(name).over(before).alias(f"{name}_out") for name, fn, _ in down], *[fn(name).over(after).alias(f"{name}_out") for name, fn, _ in up])
    upto = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.partitionBy("part").orderBy("value").rowsBetween(1, Window.unboundedFollowing)
    inner = met.select("*", *[fn(c).over(upto).alias(name) for name, fn, c in down], *[fn(c).over(above).alias(name) for name, fn, c in up]).join(F.broadcast(outer), "part")
    merge = {F.min: F.least, F.max: F.greatest}
    out = inner
    for name, fn, _ in [*down, *up]:
        both = merge[fn](F.col(name), F.col(f"{name}_out")) if fn in merge else F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"{name}_out"), F.lit(0))
        out = out.withColumn(name, both)
    return out.drop("part", *[f"{name}_out" for name, *_ in [*down, *up]])


def boxes(rows: DataFrame, column: str, numbers: list[str]) -> DataFrame:
    """(value, below, above, <c>_blo, <c>_bhi, <c>_alo, <c>_ahi) for 'column <= value' and 'column > value' at every value.

    The column's own box is that of its values; the sides' sizes are the counted rows.
    """
    values = by_value(rows, column, [c for c in numbers if c != column]).withColumns({f"{column}_lo": F.col("value"), f"{column}_hi": F.col("value")})
    down, up = [("below", F.sum, "n")], [("above", F.sum, "n")]
    for c in numbers:
        down += [(f"{c}_blo", F.min, f"{c}_lo"), (f"{c}_bhi", F.max, f"{c}_hi")]
        up += [(f"{c}_alo", F.min, f"{c}_lo"), (f"{c}_ahi", F.max, f"{c}_hi")]
    out = running(values, down, up)
    return out.select("value", F.col("below").cast("long").alias("below"), F.coalesce("above", F.lit(0)).cast("long").alias("above"), *[f"{c}_{e}" for c in numbers for e in ("blo", "bhi", "alo", "ahi")])


def distinct_counts(rows: DataFrame, column: str, category: str) -> DataFrame:
    """(value, below, above): how many different categories stand up to each value of the column, and above it.

    A category counts from its first value on, and until its last.
    """
    ends = rows.where(F.col(column).isNotNull() & F.col(category).isNotNull()).groupBy(category).agg(F.min(column).alias("first"), F.max(column).alias("last"))
    first = ends.groupBy(F.col("first").alias("value")).agg(F.count("*").alias("f"))
    last = ends.groupBy(F.col("last").alias("value")).agg(F.count("*").alias("l"))
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    marked = values.join(first, "value", "left").join(last, "value", "left").fillna(0, ["f", "l"])
    out = running(marked, [("below", F.sum, "f")], [("above", F.sum, "l")])
    return out.select("value", F.coalesce("below", F.lit(0)).cast("long").alias("below"), F.coalesce("above", F.lit(0)).cast("long").alias("above"))


def _touches(query: Query, side: str) -> Column:
    out = F.lit(True)
    for c, (lo, hi) in query.items():
        out = out & (F.col(f"{c}_{side}hi") >= F.lit(lo) if lo is not None else F.lit(True)) & (F.col(f"{c}_{side}lo") <= F.lit(hi) if hi is not None else F.lit(True))
    return F.coalesce(out, F.lit(False))


def cut_costs(rows: DataFrame, column: str, numbers: list[str], queries: list[Query], least: int) -> DataFrame:
    """(value, below, above, cost): the share of the rows that the queries read after a cut at each value, where both sides
    hold at least `least` rows. Queries are over the numbers, and each touches the table."""
    at = boxes(rows, column, numbers).where((F.col("below") >= least) & (F.col("above") >= least))
    read = sum((F.when(_touches(q, "b"), F.col("below")).otherwise(0) + F.when(_touches(q, "a"), F.col("above")).otherwise(0) for q in queries), F.lit(0))
    return at.select("value", "below", "above", (read / ((F.col("below") + F.col("above")) * len(queries))).alias("cost"))


def best_cut(rows: DataFrame, columns: list[str], queries: list[Query], least: int) -> DataFrame:
    """(column, value, cost): of each column the cheapest cut, the smallest value of equal ones."""
    out = None
    for c in columns:
        best = cut_costs(rows, c, columns, queries, least).agg(F.min(F.struct(F.round("cost", 9).alias("cost"), F.col("value").cast("double").alias("value"))).alias("m"))
        one = best.where("m is not null").select(F.lit(c).alias("column"), F.col("m.value").alias("value"), F.col("m.cost").alias("cost"))
        out = one if out is None else out.unionByName(one)
    return out


def category_costs(rows: DataFrame, column: str, sets: list[list], numbers: list[str], queries: list[Query]) -> DataFrame:
    """(set_id, inside, outside, cost) of cuts 'column in set': one aggregate for all sets.

    Queries name ranges of numbers, or values of the column as a list; a side that can hold neither is not read.
    """
    aggs = []
    for i, values in enumerate(sets):
        hit = F.coalesce(F.col(column).isin(values), F.lit(False))
        aggs += [F.count_if(hit).alias(f"n{i}_b"), F.count_if(~hit).alias(f"n{i}_a")]
        for c in numbers:
            for side, where in (("b", hit), ("a", ~hit)):
                aggs += [F.min(F.when(where, F.col(c))).alias(f"{c}_{i}{side}lo"), F.max(F.when(where, F.col(c))).alias(f"{c}_{i}{side}hi")]
    one = rows.agg(*aggs)
    out = []
    for i, values in enumerate(sets):
        read = F.lit(0)
        for q in queries:
            for side in "ba":
                meets = _touches({c: v for c, v in q.items() if c != column}, f"{i}{side}")
                if column in q:
                    meets = meets & F.lit(bool(set(q[column]) & set(values)) if side == "b" else bool(set(q[column]) - set(values)))
                read = read + F.when(meets, F.col(f"n{i}_{side}")).otherwise(0)
        total = F.col(f"n{i}_b") + F.col(f"n{i}_a")
        out.append(F.struct(F.lit(i).alias("set_id"), F.col(f"n{i}_b").alias("inside"), F.col(f"n{i}_a").alias("outside"), (read / (total * len(queries))).alias("cost")))
    return one.select(F.explode(F.array(*out)).alias("c")).select("c.*")


def thinned(cuts: DataFrame, by: str, order: Column, limit: int) -> DataFrame:
    """At most `limit` cuts of each column, those with the smallest key: the cap on candidates of a tree."""
    w = Window.partitionBy(by).orderBy(order)
    return cuts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
