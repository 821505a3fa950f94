"""Invariants of layouts, files, curves, costs, policies and samples."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.functions import text as T
from pageloom.operators import knn, orders, pages, partial, policies, predicates, stats, transforms, workload
from pageloom.operators.ranking import ranked
from pageloom.sources import sinks, vector_files
from pageloom.streaming.windows import DecayedReservoir


@pytest.fixture(scope="module")
def base(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist(), i % 4) for i in range(61)]
    rows.append((61, rows[0][1], 0))  # a duplicate vector
    rows.append((62, [0.0] * 6, 1))  # a zero vector
    return spark.createDataFrame(rows, "vec_id long, v array<double>, label int").repartition(3).cache()


@pytest.fixture(scope="module")
def queries(base):
    return base.where("vec_id % 10 = 0").select(F.expr("vec_id div 10").alias("query_id"), F.col("v").alias("q"))


def test_orders_are_permutations(base, queries):
    cent, qbar = stats.centroids(base), stats.mean_direction(queries)
    for layout in (
        orders.kmeans_order(base, cent),
        orders.cosine_order(base, cent),
        orders.angular_pull_order(base, cent, qbar),
        orders.attraction_order(base, cent, qbar),
        orders.idistance_order(base, cent),
        orders.z_order(base, 3, 5),
        orders.scattered_order(base),
        transforms.curve_order(base, 4),
    ):
        pages.check_layout(layout, 8)
        got = pages.page_map(layout, 8).collect()
        assert sum(len(r["members"]) for r in got) == 63 and max(len(r["members"]) for r in got) == 8


def test_query_layout_fills_blocks(base, queries):
    layout = transforms.query_layout(base, queries, 6, transforms.LayoutConfig(capacity=8)).cache()
    pages.check_layout(layout, 8)
    assert layout.groupBy("cid").count().agg(F.max("count")).first()[0] <= 8


def test_layout_errors(spark, base):
    with pytest.raises(ValueError):
        pages.check_layout(spark.createDataFrame([(1, 0), (1, 1)], "vec_id long, pos long"), 4)
    with pytest.raises(ValueError):
        partial.covered(10, 4, 1.5)
    with pytest.raises(ValueError):
        orders.morton(F.array(F.lit(1)), 64, 2)


def test_curves():
    grid = np.array([[x, y] for x in range(8) for y in range(8)])
    path = grid[np.argsort(np.array([int.from_bytes(k, "big") for k in transforms.hilbert_binary(grid, 3)]))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
    keys = [int.from_bytes(k, "big") for k in transforms.morton_binary(grid, 3)]
    assert keys == [sum((x >> b & 1) << (2 * b) | (y >> b & 1) << (2 * b + 1) for b in range(3)) for x, y in grid.tolist()]


def test_ranked_groups(spark):
    rows = [(g, float(v % 7), i) for i, (g, v) in enumerate((g, v) for g in range(3) for v in range(50))]
    got = ranked(spark.createDataFrame(rows, "g int, x double, i long"), "x", "i", ("g",)).collect()
    for g in range(3):
        mine = sorted((r["x"], r["i"]) for r in got if r["g"] == g)
        assert [r["rank"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["x"], r["i"]))] == list(range(len(mine)))


def test_eigen_is_canonical():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5))
    values, vectors = transforms.eigen(np.cov(x.T))
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, np.cov(x.T))
    assert (vectors[np.abs(vectors).argmax(0), range(5)] > 0).all()


def test_covariance_paths_agree(base):
    m = stats.covariance_matrix(base, "v", 6)
    for r in stats.covariance(base).collect():
        assert abs(m[r["i"], r["j"]] - r["cov"]) < 1e-9


def test_partial_search_is_exact(base, queries):
    reps = queries.where("query_id = 2").select(F.lit(0).cast("long").alias("layout_id"), F.col("q").alias("rep"))
    members = partial.partial_layouts(base, reps, 8, 1.0)
    found = partial.search(members, reps, queries.withColumn("layout_id", F.lit(0).cast("long")), 5, 1.0).collect()
    truth = {}
    for r in knn.exact(queries, base, 5).collect():
        truth.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {r["query_id"]: r["neighbours"] for r in found} == {q: [v for _, v in sorted(n)] for q, n in truth.items()}


def _scan(s, d, sq, limit):
    """The scan itself, step by step."""
    c = min(int(np.searchsorted(s, sq)), len(s) - 1)
    held, touched = [d[c]], False
    for step in (-1, 1):
        i = c + step
        while 0 <= i < len(s):
            if len(held) < limit or d[i] < max(held):
                held = sorted([*held, d[i]])[:limit]
            if len(held) >= limit and abs(s[i] - sq) >= max(held):
                break
            i += step
        touched |= i < 0 or i >= len(s)
    return touched


def test_boundary_flags(base, queries):
    x = {r["vec_id"]: np.array(r["v"]) for r in base.collect()}
    rep = x[0]
    reps = base.where("vec_id = 0").select(F.lit(0).cast("long").alias("layout_id"), F.col("v").alias("rep"))
    members = partial.partial_layouts(base, reps, 8, 0.5).cache()
    order = [(r["s"], r["vec_id"]) for r in members.orderBy("rank").collect()]
    for r in partial.search(members, reps, queries.withColumn("layout_id", F.lit(0).cast("long")), 3, 1.4).collect():
        q = x[r["query_id"] * 10]
        d = np.round([np.linalg.norm(x[v] - q) for _, v in order], 9)
        assert r["touched"] == _scan(np.array([s for s, _ in order]), d, round(float(np.linalg.norm(q - rep)), 9), 5)


def test_smooth_shares():
    zero = np.zeros(1, int)
    line = partial.SmoothShares([(np.array([0.0, 2.0]), np.array([1.0, 3.0]))])
    assert line(zero, np.array([1.0]))[0] == 2.0 and line(zero, np.array([4.0]))[0] == 5.0
    x, y = np.array([0.0, 1.0, 2.0, 4.0]), np.array([0.0, 0.0, 0.5, 1.0])
    both = partial.SmoothShares([(np.array([0.0, 2.0]), np.array([1.0, 3.0])), (x, y)])
    t = np.linspace(0, 4, 200)
    values = both(np.ones(200, int), t)
    assert (np.diff(values) >= -1e-12).all() and both(np.ones(4, int), x) == pytest.approx(y)
    # the cubic of one piece by its own definition
    k, h = 2, 2.0
    d0, d1 = both.slope[1, k], both.slope[1, k + 1]
    for u in (0.1, 0.5, 0.9):
        want = (2 * u**3 - 3 * u**2 + 1) * y[k] + (u**3 - 2 * u**2 + u) * h * d0 + (3 * u**2 - 2 * u**3) * y[k + 1] + (u**3 - u**2) * h * d1
        assert both(np.ones(1, int), np.array([x[k] + u * h]))[0] == pytest.approx(want)
    values = np.arange(100.0)
    own = partial.SmoothShares([partial.cumulative_shares(np.histogram(values, 10)[0], 0.0, 99.0, 0.0)])
    assert own.radii(zero, np.array([50.0]), np.array([0.1]), np.array([99.0]))[0] == pytest.approx(5, abs=0.5)


def test_blocks_are_the_sequential_greedy(spark):
    """Pairs in order of distance under a capacity, then whatever is left by distance to what is free."""
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(70, 3)), rng.normal(size=(9, 3))
    x[:30] *= 0.05  # a crowd around one place
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, v array<double>").repartition(3)
    d = np.round(np.linalg.norm(x[:, None] - c[None], axis=2), 9)
    near = np.argsort(d, 1, kind="stable")[:, :3]
    room, want = np.full(9, 8), {}
    for _, i, k in sorted((d[i, k], i, k) for i in range(70) for k in near[i]):
        if i not in want and room[k]:
            want[i] = k
            room[k] -= 1
    for _, i, k in sorted((d[i, k], i, k) for i in range(70) if i not in want for k in range(9)):
        if i not in want and room[k]:
            want[i] = k
            room[k] -= 1
    assert len(want) == 70
    got = {r["vec_id"]: r["cid"] for r in transforms.assign_blocks(rows, c, 8, nearest=3).collect()}
    assert got == want


def test_gravity_by_hand():
    x, anchors = np.array([[0.0, 0.0]]), np.array([[1.0, 0.0], [0.0, 2.0]])
    dc = np.sqrt(5)
    want = 0.3 * (1 + dc * np.array([1.0, 0.0]) + dc / 4 * np.array([0.0, 2.0]))
    assert np.allclose(transforms.towards_queries(x, anchors, 3, 0.3), want)
    own = transforms.towards_selves(np.array([[0.0, 0.0]]), np.array([[0.0, 1.0], [0.0, 3.0]]), 2.0, 1, 0.5)
    assert np.allclose(own, np.array([0.0, 1.0]) + 0.5 * (1 + 2.0 * 3.0 / 9 * np.array([0.0, 2.0])))


def test_vector_files(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])], "vec_id long, embedding array<float>")
    path = str(tmp_path / "x.fvecs")
    sinks.write_vecs(rows, path)
    got = vector_files.load_vectors(spark, path)
    assert sorted(map(tuple, got.select("vec_id", F.col("embedding")[0], F.col("embedding")[1]).collect())) == [(0, 1.0, 2.0), (1, 3.0, 4.0), (2, 5.0, 6.0)]
    queries = got.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    windows = workload.windows(queries, 2).orderBy("window_id").collect()
    assert [r["query_count"] for r in windows] == [2, 1]
    names = policies.schedule_tables(workload.windows(queries, 2), "demo", "ivfflat").orderBy("window_id").collect()
    assert [r["table_name"] for r in names] == ["demo_window_0_ivfflat", "demo_window_1_ivfflat"]
    sinks.write_xbin(rows, str(tmp_path / "x.fbin"))
    assert vector_files.load_vectors(spark, str(tmp_path / "x.fbin")).count() == 3
    with open(path, "ab") as f:
        f.write(struct.pack("<iff", 3, 0, 0))
    with pytest.raises(Exception, match="does not have 2 values"):
        vector_files.read_vecs(spark, path).count()


def test_artifacts(spark, base, tmp_path):
    layout = pages.paged(orders.scattered_order(base), 10).cache()
    sinks.write_partition_bin(layout, str(tmp_path / "p.bin"), 10)
    raw = (tmp_path / "p.bin").read_bytes()
    capacity, n_pages, n = struct.unpack_from("<QQQ", raw)
    assert (capacity, n_pages, n) == (10, 7, 63)
    at, seen = 24, {}
    for page in range(n_pages):
        k = struct.unpack_from("<I", raw, at)[0]
        seen.update({i: page for i in struct.unpack_from(f"<{k}I", raw, at + 4)})
        at += 4 + 4 * k
    assert list(struct.unpack_from(f"<{n}I", raw, at)) == [seen[i] for i in range(n)] and len(raw) == at + 4 * n
    assert len(sinks.write_layout(layout, str(tmp_path / "out"), "page_groups", 10)) == 3
    assert json.loads((tmp_path / "out/manifest.json").read_text())["num_pages"] == 7
    sinks.write_layout_csv(layout, base, str(tmp_path / "csv"), 6, one_file=True)
    back = vector_files.read_csv_vectors(spark, str(tmp_path / "csv"))
    assert [r["vec_id"] for r in back.collect()] == [r["vec_id"] for r in layout.orderBy("pos").collect()]


def test_names(spark):
    assert sinks.table_family("window-0-Demo") == {"base": "window_0_demo", "ivfflat": "window_0_demo_ivfflat", "hnsw": "window_0_demo_hnsw"}
    rows = spark.createDataFrame([("results/9-a b.csv",), ("__x__",)], "n string")
    assert [r[0] for r in rows.select(T.identifier(F.col("n"))).collect()] == ["layout_9_a_b", "x"]
    assert spark.createDataFrame([('"1 2 3"',), ("[4, 5]",), (None,)], "s string").select(T.id_list(F.col("s"))).collect()[1][0] == [4, 5]


def test_policies(spark):
    rows = [(w, f"w{w}_{s}", s, c, m) for w, costs in enumerate([(1.0, 5.0), (5.0, 1.0), (5.0, 1.0), (5.0, 1.0)]) for s, c, m in (("base", costs[0], 0.0), ("hot", costs[1], 2.0))]
    fam = spark.createDataFrame(rows, "window_id long, candidate_id string, layout_label string, query_cost double, movement_cost double")
    assert [r["layout_label"] for r in policies.greedy(fam).orderBy("window_id").collect()] == ["base", "hot", "hot", "hot"]
    got = policies.counter(fam, alpha=8.0, seed=1).orderBy("window_id").collect()
    assert [r["switched"] for r in got][:2] == [False, False] and all(r["movement_cost"] == (8.0 if r["switched"] else 0.0) for r in got)
    phased = policies.PhasedCounter(["a", "b"], alpha=2.0, seed=0)
    states = [phased.query({"a": 1.0, "b": 0.1})[0] for _ in range(6)]
    assert states[0] == "a" and "b" in states


def test_reservoir():
    r = DecayedReservoir(20, 5, seed=1)
    for i in range(60):
        r.insert(list(range(5 * i, 5 * i + 5)))
        assert len(r.sample()) <= 20
    assert np.mean(r.full) > 150  # recent items prevail


def test_predicate_tree(spark):
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 20).cast("double").alias("a"), (F.col("id") / 4).alias("b"))
    tree = predicates.grow_tree(rows, ["a", "b"], [("a", 9.0), ("b", 49.0), ("b", 24.0)], [{"b": (0.0, 20.0)}, {"a": (12.0, None)}], 4)
    labels = rows.withColumn("bid", tree.label())
    assert labels.groupBy("bid").count().count() == len(tree.leaves()) > 1
    assert sum(n.size for n in tree.leaves()) == 400
    bands = rows.withColumn("bid", F.floor(F.col("a") / 5))
    zones = predicates.zone_map(bands, "bid", ["a", "b"])
    p = predicates.Leaf("a", "between", (5.0, 9.0))
    parts = predicates.matching_parts(zones, "bid", p)
    assert parts == [1] and bands.where(F.col("bid").isin(parts)).where(p.rows()).count() == rows.where(p.sql()).count()


def test_hash_partitions(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("x"), (F.col("id") % 7).alias("y"))
    got = predicates.hash_partitions(rows, "id", F.col("x"), F.col("y"), 8).cache()
    assert got.count() == 500 and got.select("id").distinct().count() == 500
    assert got.groupBy("bid").count().agg(F.max("count")).first()[0] <= 500 // 8 + 1
