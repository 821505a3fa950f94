"""Registered queries against plain Python versions over whole tables, beyond the first ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom import registry
from pageloom.operators import partial, transforms
from pageloom.plans import workload
from pageloom.sources.tables import base_vectors

ROOT = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def costs(spark):
    out = {}
    for r in spark.read.parquet(f"{ROOT}/events.parquet").collect():
        out.setdefault(r["event_id"] // 20, np.zeros(4))[r["user_id"] % 4] += abs(r["value"])
    assert len(out) == 50
    return {w: np.round(c, 6) for w, c in out.items()}


def test_wfa_covers_every_window(spark, costs):
    work, want = np.array([0.0, 50.0, 50.0, 50.0]), {}
    for w in sorted(costs):
        work = np.minimum(work, work.min() + 50.0) + costs[w]
        want |= {(w, s): x for s, x in enumerate(work)}
    got = {(r["window_id"], r["state"]): r["work"] for r in QUERIES["wfa_trace"](spark, ROOT).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_regret_covers_every_window(spark, costs):
    total, current, want = np.zeros(4), 0, []
    for w in sorted(costs):
        moved = False
        for s in range(4):
            total[s] += costs[w][s]
            if s != current and total[current] - total[s] >= 100.0:
                current, moved, total = s, True, np.zeros(4)
                break
        want.append((w, current, moved))
    assert sorted(map(tuple, QUERIES["regret_trace"](spark, ROOT).collect())) == want


@pytest.fixture(scope="module")
def vectors(spark):
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{ROOT}/embeddings.parquet").select("vec_id", "embedding").collect())
    return np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)


def test_radius_searches_the_whole_base(spark, vectors):
    base = base_vectors(spark, ROOT)
    x = vectors[1]
    d = np.array([np.linalg.norm(x - p, axis=1) for p in x])
    np.fill_diagonal(d, np.inf)
    assert abs(partial.second_neighbour_radius(partial.radius_sample(base), base) - d.min(1).mean()) < 1e-6
    few = base.where("vec_id < 20")
    assert abs(partial.second_neighbour_radius(few, base) - d[:20].min(1).mean()) < 1e-6


def test_dis_read_fraction_uses_that_radius(spark, vectors):
    x = vectors[1]
    d = np.array([np.linalg.norm(x - p, axis=1) for p in x])
    np.fill_diagonal(d, np.inf)
    r, c = d.min(1).mean(), x.mean(0)
    s = np.sort(np.linalg.norm(x - c, axis=1))
    blocks = np.minimum(np.arange(len(s)) // (len(s) // 20 + 1), 19)
    want = {}
    for q, v in zip(vectors[0][vectors[0] % 10 == 0] // 10, x[vectors[0] % 10 == 0], strict=True):
        at = np.linalg.norm(v - c)
        hit = [b for b in np.unique(blocks) if s[blocks == b].max() >= max(0.0, at - r) and s[blocks == b].min() <= at + r]
        want[int(q)] = (len(hit), round(float(np.isin(blocks, hit).mean()), 6))
    assert {r["query_id"]: (r["blocks"], r["fraction"]) for r in QUERIES["dis_read_fraction"](spark, ROOT).collect()} == want


def _farthest(x, k):
    chosen = [0]
    while len(chosen) < k:
        chosen.append(int(np.min([np.linalg.norm(x - x[c], axis=1) for c in chosen], axis=0).argmax()))
    return x[chosen]


def _table(rows):
    out = {}
    for r in rows:
        out.setdefault(r["vec_id"], {})[r["i"]] = r["x"]
    return np.array([[out[i][j] for j in range(len(out[i]))] for i in sorted(out)])


def test_gravity_anchors_come_from_all_queries(spark, vectors):
    ids, x = vectors
    a = _farthest(x[ids % 10 == 0], 16)  # 4 ln 50
    between = np.array([[np.linalg.norm(p - q) for q in a] for p in a])
    dc, want = between[between > 0].mean(), []
    for v in x:
        d = np.linalg.norm(a - v, axis=1)
        near = np.argsort(d, kind="stable")[:3]
        want.append(v + 0.3 * (1 + sum(dc / max(d[j] ** 2, 1e-8) * (a[j] - v) for j in near)))
    got, want = _table(QUERIES["gravity_q2d"](spark, ROOT).collect()), np.array(want)
    apart = ids % 10 != 0  # a query that is an anchor meets itself at a distance of rounding only
    assert got.shape == want.shape and np.allclose(got[apart], want[apart], atol=1e-4)


def test_gravity_selves_anchors_come_from_all_vectors(spark, vectors):
    x = vectors[1]
    a = _farthest(x, 25)  # 4 ln 500
    assert np.array_equal(transforms.base_anchors(base_vectors(spark, ROOT)), a)
    d = np.array([np.linalg.norm(a - v, axis=1) for v in x])
    dc, want = np.sort(d, 1)[:, 1].mean(), []
    for far in d:
        near = np.argsort(far, kind="stable")[:4]
        a0, d1 = a[near[0]], far[near[1]]
        want.append(a0 + 0.3 * (1 + sum(dc * d1 / max(far[j] ** 2, 1e-8) * (a[j] - a0) for j in near[1:])))
    assert np.allclose(_table(QUERIES["gravity_selves"](spark, ROOT).collect()), np.array(want), atol=1e-4)


def test_cost_profiles_count_the_blocks(spark):
    root = "/root/testdata/sf0.1"  # 2,000 vectors, so 125 blocks
    base, reps, queries, members = workload._layouts(spark, root)
    metas, costs = partial.block_metas(members), []
    for i in (0, 1):
        every = queries.withColumn("layout_id", F.lit(i).cast("long"))
        hits = partial.midpoint_costs(every, reps.where(F.col("layout_id") == i), metas.where(F.col("layout_id") == i), 125)
        costs.append({r["query_id"]: r["cost"] for r in hits.collect()})
    assert costs[0].keys() == costs[1].keys() and len(costs[0]) == 200
    want = np.mean([abs(costs[0][q] - costs[1][q]) for q in costs[0]])
    got = {r["layout_id"]: r["distance"] for r in QUERIES["cost_profile_distance"](spark, root).collect()}
    assert abs(got[0] - want) < 1e-5 and sorted(got) == list(range(19))  # every layout but the last
