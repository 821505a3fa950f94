"""Predicates that compile to row filters, to SQL text and to zone-map tests; zone maps, cuts and skip costs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    """One column's condition: in (values), between (lo and hi, None where open; ends included), le or gt (one value)."""

    column: str
    kind: str
    values: tuple

    def rows(self) -> Column:
        c, v = F.col(self.column), self.values
        if self.kind == "in":
            return c.isin(*v)
        if self.kind == "le":
            return c <= F.lit(v[0])
        if self.kind == "gt":
            return c > F.lit(v[0])
        return self._ends(c, c)

    def touches(self) -> Column:
        """Whether a partition with columns <c>_lo, <c>_hi (and <c>_set, null if too large) can hold such rows."""
        lo, hi, v = F.col(f"{self.column}_lo"), F.col(f"{self.column}_hi"), self.values
        if self.kind == "in":
            inside = F.exists(F.array(*[F.lit(x) for x in v]), lambda x: (x >= lo) & (x <= hi))
            return inside & F.coalesce(F.arrays_overlap(F.col(f"{self.column}_set"), F.array(*[F.lit(x) for x in v])), F.lit(True))
        if self.kind == "le":
            return lo <= F.lit(v[0])
        if self.kind == "gt":
            return hi > F.lit(v[0])
        return self._ends(hi, lo)

    def _ends(self, low: Column, high: Column) -> Column:
        lo, hi = self.values
        out = F.lit(True)
        if lo is not None:
            out = out & (low >= F.lit(lo))
        return out & (high <= F.lit(hi)) if hi is not None else out

    def sql(self) -> str:
        def q(x) -> str:
            return str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"

        v = self.values
        if self.kind == "in":
            return f"{self.column} in ({', '.join(map(q, v))})"
        if self.kind in ("le", "gt"):
            return f"{self.column} {'<=' if self.kind == 'le' else '>'} {q(v[0])}"
        parts = [f"{self.column} {op} {q(x)}" for op, x in ((">=", v[0]), ("<=", v[1])) if x is not None]
        return " and ".join(parts) or "true"

    def leaves(self) -> list[Leaf]:
        """Half-open leaves: a closed range is two."""
        if self.kind == "between" and None not in self.values:
            return [Leaf(self.column, "between", (self.values[0], None)), Leaf(self.column, "between", (None, self.values[1]))]
        return [self]

    def columns(self) -> set[str]:
        return {self.column}


@dataclass(frozen=True)
class Tree:
    """and / or of two predicates."""

    left: Leaf | Tree
    right: Leaf | Tree
    both: bool

    def rows(self) -> Column:
        return self.left.rows() & self.right.rows() if self.both else self.left.rows() | self.right.rows()

    def touches(self) -> Column:
        return self.left.touches() & self.right.touches() if self.both else self.left.touches() | self.right.touches()

    def sql(self) -> str:
        return f"({self.left.sql()} {'and' if self.both else 'or'} {self.right.sql()})"

    def leaves(self) -> list[Leaf]:
        return [*self.left.leaves(), *self.right.leaves()]

    def columns(self) -> set[str]:
        return self.left.columns() | self.right.columns()


def build(parts: list, ands: list[bool]) -> Leaf | Tree:
    """Predicates joined from left to right."""
    return reduce(lambda acc, step: Tree(acc, step[0], step[1]), zip(parts[1:], ands, strict=True), parts[0])


def zone_map(rows: DataFrame, by: str, columns: list[str], sets: Iterable[str] = (), set_limit: int = 1000) -> DataFrame:
    """(by, size, <c>_lo, <c>_hi, <c>_set): extremes of every column, and the values of the named ones up to a limit."""
    aggs = [F.count("*").alias("size")]
    for c in columns:
        aggs += [F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi")]
    out = rows.groupBy(by).agg(*aggs)
    for c in sets:
        # different values first, so a partition never gathers more than its cardinality
        values = rows.select(by, c).distinct().groupBy(by).agg(F.count(c).alias("_n"), F.array_sort(F.collect_set(c)).alias("_s"))
        out = out.join(values.select(by, F.when(F.col("_n") <= set_limit, F.col("_s")).alias(f"{c}_set")), by, "left")
    return out


def merge_zone_maps(a: DataFrame, b: DataFrame, by: str, columns: list[str], sets: Iterable[str] = (), set_limit: int = 1000) -> DataFrame:
    """The zone map after more rows came. A set that is unknown on one side, or too large together, is unknown."""
    both = a.unionByName(b, allowMissingColumns=True)
    aggs = [F.sum("size").alias("size")]
    for c in columns:
        aggs += [F.min(f"{c}_lo").alias(f"{c}_lo"), F.max(f"{c}_hi").alias(f"{c}_hi")]
    for c in sets:
        values = F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{c}_set"))))  # two sets of at most set_limit values
        aggs.append(F.when((F.count_if(F.col(f"{c}_set").isNull()) == 0) & (F.size(values) <= set_limit), values).alias(f"{c}_set"))
    return both.groupBy(by).agg(*aggs)


def category_boxes(rows: DataFrame, by: str, columns: list[str], limit: int, buckets: int) -> DataFrame:
    """(by, column, kind, values, lo, hi): a category's values as a set, or as a range of hash buckets if there are more than the limit.

    Different values come first, so a partition never gathers more than the limit. A bucket is the MD5's last byte modulo `buckets`.
    """
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    values = rows.select(by, listed).select(by, "p.column", "p.value").where("value is not null").distinct()
    bucket = F.conv(F.substring(F.md5(F.col("value").cast("binary")), 31, 2), 16, 10).cast("long") % buckets
    counted = values.groupBy(by, "column").agg(F.count("*").alias("n"), F.min(bucket).alias("lo"), F.max(bucket).alias("hi"))
    small = values.join(counted.where(F.col("n") <= limit).select(by, "column"), [by, "column"]).groupBy(by, "column").agg(F.array_sort(F.collect_list("value")).alias("values"))
    many = F.col("n") > limit
    met = counted.join(small, [by, "column"], "left")
    return met.select(by, "column", F.when(many, "range").otherwise("set").alias("kind"), "values", F.when(many, F.col("lo")).alias("lo"), F.when(many, F.col("hi")).alias("hi"))


def read_fractions(zones: DataFrame, predicates: list, n: int) -> DataFrame:
    """(query_id, parts, fraction): partitions that each predicate must read and their share of the rows. One pass over the zone map."""
    aggs = []
    for i, p in enumerate(predicates):
        aggs += [F.count_if(p.touches()).alias(f"p{i}"), (F.sum(F.when(p.touches(), F.col("size")).otherwise(0)) / n).alias(f"f{i}")]
    one = zones.agg(*aggs)
    listed = F.array(*[F.struct(F.lit(i).cast("long").alias("query_id"), F.col(f"p{i}").alias("parts"), F.col(f"f{i}").alias("fraction")) for i in range(len(predicates))])
    return one.select(F.explode(listed).alias("r")).select("r.*")


def matching_parts(zones: DataFrame, by: str, predicate) -> list:
    """The partitions to read: a value a partition comes to the driver, to become a partition filter."""
    return [r[0] for r in zones.where(predicate.touches()).select(by).collect()]


def candidate_cuts(rows: DataFrame, predicates: list, min_size: int) -> DataFrame:
    """(column, cut, above, below): 'column > cut' for every bound in the workload with at least min_size rows on both sides.

    One aggregate scores all cuts.
    """
    bounds = sorted({(leaf.column, x) for p in predicates for leaf in p.leaves() if leaf.kind != "in" for x in leaf.values if x is not None})
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(c) > F.lit(x)).alias(f"a{i}") for i, (c, x) in enumerate(bounds)])
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(x)).alias("cut"), F.col(f"a{i}").alias("above"), (F.col("n") - F.col(f"a{i}")).alias("below")) for i, (c, x) in enumerate(bounds)])
    out = counts.select(F.explode(listed).alias("c")).select("c.*")
    return out.where((F.col("above") >= min_size) & (F.col("below") >= min_size))


def median_cut(rows: DataFrame, column: str):
    """The value at place n div 2, stepped down to the next smaller one if it is the largest; None for a constant column."""
    n = rows.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if ends["lo"] == ends["hi"]:
        return None
    from pageloom.operators.sweeps import by_value, running

    upto = running(by_value(rows, column, []), [("upto", F.sum, "n")], [])
    at = upto.where(F.col("upto") > n // 2).agg(F.min("value")).first()[0]
    return at if at < ends["hi"] else rows.where(F.col(column) < F.lit(at)).agg(F.max(column)).first()[0]


def top_columns(predicates: list, types: dict[str, float], limit: int = 2) -> list[tuple[str, float]]:
    """Columns by how many predicates use them, plus a bonus by type."""
    used: dict[str, float] = {}
    for p in predicates:
        for c in p.columns():
            used[c] = used.get(c, 0.0) + 1
    return sorted(((c, n + types.get(c, 0.0)) for c, n in used.items()), key=lambda x: (-x[1], x[0]))[:limit]


# --- a tree of cuts ------------------------------------------------------------------------------------------


@dataclass
class Node:
    """A leaf of rows, or a cut 'column > value' with its two sides."""

    name: int
    size: int
    box: dict[str, tuple]
    cut: tuple[str, float] | None = None
    below: Node | None = None
    above: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.cut is None else [*self.below.leaves(), *self.above.leaves()]

    def label(self) -> Column:
        """The leaf's name for each row; null goes below."""
        if self.cut is None:
            return F.lit(self.name)
        c, x = self.cut
        return F.when(F.col(c) > F.lit(x), self.above.label()).otherwise(self.below.label())

    def to_dict(self) -> dict:
        own = {"name": self.name, "size": self.size}
        return own if self.cut is None else own | {"cut": list(self.cut), "below": self.below.to_dict(), "above": self.above.to_dict()}

    @classmethod
    def from_dict(cls, found: dict) -> Node:
        """A tree that to_dict() wrote down; boxes are not kept."""
        sides = {k: cls.from_dict(found[k]) for k in ("below", "above") if k in found}
        return cls(found["name"], found["size"], {}, tuple(found["cut"]) if "cut" in found else None, **sides)

    def lines(self, depth: int = 0) -> list[str]:
        """The tree as indented text."""
        if self.cut is None:
            return [f"{'  ' * depth}leaf {self.name}: {self.size} rows"]
        return [f"{'  ' * depth}{self.cut[0]} > {self.cut[1]}", *self.below.lines(depth + 1), *self.above.lines(depth + 1)]


def _meets(box: dict[str, tuple], query: dict[str, tuple]) -> bool:
    return all((lo is None or box[c][1] >= lo) and (hi is None or box[c][0] <= hi) for c, (lo, hi) in query.items() if c in box and box[c][0] is not None)


def cut_score(sides: list[tuple[int, dict]], queries: list[dict[str, tuple]], parent: dict) -> float:
    """The share of the node's rows that the queries which touch it still read after a cut."""
    own = [q for q in queries if _meets(parent, q)]
    n = sum(size for size, _ in sides)
    if not own or not n:
        return 1.0
    return sum(size for q in own for size, box in sides if _meets(box, q)) / (n * len(own))


def _box(rows: DataFrame, columns: list[str]) -> tuple[int, dict[str, tuple]]:
    r = rows.agg(F.count("*").alias("n"), *[F.min(c).alias(f"{c}_lo") for c in columns], *[F.max(c).alias(f"{c}_hi") for c in columns]).first()
    return r["n"], {c: (r[f"{c}_lo"], r[f"{c}_hi"]) for c in columns}


def _median_of(rows: DataFrame, root: Node, node: Node, columns: list[str]) -> tuple[str, float] | None:
    """The median cut of a node's first column that varies."""
    mine = rows.where(root.label() == node.name)
    for c in columns:
        if node.box[c][0] != node.box[c][1] and (at := median_cut(mine, c)) is not None:
            return c, at
    return None


def categorical_cuts(rows: DataFrame, predicates: list, min_size: int, most: int = 2000) -> DataFrame:
    """(column, values, inside, outside): 'column in values' for every set of the workload, but for columns with more than
    `most` different values, where both sides hold at least min_size rows. One aggregate scores all."""

    def found(p) -> list:
        return [p] if isinstance(p, Leaf) else [*found(p.left), *found(p.right)]

    sets = sorted({(x.column, tuple(sorted(x.values))) for p in predicates for x in found(p) if x.kind == "in"})
    names = sorted({c for c, _ in sets})
    counts = rows.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"d_{c}") for c in names], *[F.count_if(F.col(c).isin(*v)).alias(f"c{i}") for i, (c, v) in enumerate(sets)])
    listed = [F.struct(F.lit(c).alias("column"), F.lit(",".join(v)).alias("values"), F.col(f"c{i}").alias("inside"), (F.col("n") - F.col(f"c{i}")).alias("outside"), F.col(f"d_{c}").alias("d")) for i, (c, v) in enumerate(sets)]
    out = counts.select(F.explode(F.array(*listed)).alias("c")).select("c.*")
    return out.where((F.col("inside") >= min_size) & (F.col("outside") >= min_size) & (F.col("d") <= most)).drop("d")


def grow_tree(rows: DataFrame, columns: list[str], cuts: list[tuple[str, float]], queries: list[dict[str, tuple]], k: int, fallback: bool = False) -> Node:
    """A tree of at most k leaves, level by level, nodes with most rows times cost first.

    Each level is one aggregate over the rows: sizes and boxes of both sides of every cut in every node. A cut
    must leave half of n / k rows on both sides and read less than 0.99 of what the node reads. A node without
    such a cut stays a leaf, or with `fallback` is cut at the median of its first column that varies.
    """
    first = rows.agg(F.count("*").alias("n"), *[F.min(c).alias(f"{c}_lo") for c in columns], *[F.max(c).alias(f"{c}_hi") for c in columns]).first()
    root = Node(0, first["n"], {c: (first[f"{c}_lo"], first[f"{c}_hi"]) for c in columns})
    least, names, open_nodes = (first["n"] // k) // 2, 1, [root]
    listed = F.array(*[F.struct(F.lit(i).alias("cut"), (F.col(c) > F.lit(x)).alias("side")) for i, (c, x) in enumerate(cuts)])
    while open_nodes and len(root.leaves()) < k and cuts:
        at = rows.select(root.label().alias("node"), *columns, F.explode(listed).alias("c"))
        at = at.where(F.col("node").isin([n.name for n in open_nodes]))
        stats = at.groupBy("node", "c.cut", F.coalesce("c.side", F.lit(False)).alias("side")).agg(F.count("*").alias("n"), *[F.min(c).alias(f"{c}_lo") for c in columns], *[F.max(c).alias(f"{c}_hi") for c in columns])
        sides: dict = {}
        for r in stats.collect():  # two rows a node and cut
            sides.setdefault(r["node"], {}).setdefault(r["cut"], {})[r["side"]] = (r["n"], {c: (r[f"{c}_lo"], r[f"{c}_hi"]) for c in columns})
        grown = []
        cost = {n.name: sum(_meets(n.box, q) for q in queries) for n in open_nodes}
        for node in sorted(open_nodes, key=lambda n: (-n.size * cost[n.name], n.name)):
            if len(root.leaves()) >= k or node.size < 2 * least:
                continue
            best = (0.99, None)
            for i, both in sorted(sides.get(node.name, {}).items()):
                if len(both) == 2 and min(both[False][0], both[True][0]) >= max(1, least):
                    s = cut_score([both[False], both[True]], queries, node.box)
                    if s < best[0] * (0.99 if best[1] is not None else 1):
                        best = (s, i)
            cut = cuts[best[1]] if best[1] is not None else None
            both = sides[node.name][best[1]] if cut else None
            if cut is None and fallback and (cut := _median_of(rows, root, node, columns)):
                both = {side: _box(rows.where((root.label() == node.name) & where), columns) for side, where in ((False, ~F.coalesce(F.col(cut[0]) > F.lit(cut[1]), F.lit(False))), (True, F.col(cut[0]) > F.lit(cut[1])))}
            if cut is not None:
                node.cut = cut
                node.below, node.above = Node(names, *both[False]), Node(names + 1, *both[True])
                names += 2
                grown += [node.below, node.above]
        open_nodes = grown
    return root


# --- hash partitions -----------------------------------------------------------------------------------------


def hash_partitions(rows: DataFrame, id_col: str, first: Column, second: Column, k: int) -> DataFrame:
    """(id, bid): n div k + 1 rows a bucket at most; a bucket is the MD5 of the first key's text modulo k.

    What overflows tries the second key's bucket, in id order, as far as that has room after the first pass; the
    rest fills the free places in bucket order. Places are counted, so no step walks over rows one by one.
    """
    from pyspark.sql import Window

    from pageloom.functions.text import md5_bucket
    from pageloom.operators.ranking import ranked

    n = rows.count()
    room = n // k + 1
    keyed = rows.select(F.col(id_col).alias("id"), md5_bucket(first.cast("string"), k).alias("b1"), md5_bucket(second.cast("string"), k).alias("b2"))
    one = keyed.withColumn("r", F.row_number().over(Window.partitionBy("b1").orderBy("id")))
    kept = one.where(F.col("r") <= room).select("id", F.col("b1").alias("bid"))
    over = one.where(F.col("r") > room)
    used = kept.groupBy("bid").count()
    two = over.withColumn("r2", F.row_number().over(Window.partitionBy("b2").orderBy("id"))).join(F.broadcast(used), F.col("b2") == F.col("bid"), "left")
    two = two.withColumn("fits", F.col("r2") <= room - F.coalesce("count", F.lit(0)))
    moved = two.where("fits").select("id", F.col("b2").alias("bid"))
    filled = kept.unionByName(moved).groupBy("bid").count()
    every = rows.sparkSession.range(k).select(F.col("id").alias("bid")).join(filled, "bid", "left").select("bid", (room - F.coalesce("count", F.lit(0))).alias("free"))
    upto = every.withColumn("hi", F.sum("free").over(Window.orderBy("bid"))).withColumn("lo", F.col("hi") - F.col("free"))  # k rows
    rest = ranked(two.where("not fits").select("id"), "id", "id")
    last = rest.join(F.broadcast(upto), (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("id", "bid")
    return kept.unionByName(moved).unionByName(last)
