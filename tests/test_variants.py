"""Layouts with a learned map, trees and streams, which SQL cannot follow, against plain NumPy versions."""

import numpy as np
import pytest

from pageloom import registry
from pageloom.operators import predicates as P
from pageloom.operators import transforms, variants
from pageloom.plans import predicates as PP
from pageloom.sources.tables import base_vectors, query_stream

ROOT = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def tables(spark):
    rows = sorted((r["vec_id"], r["v"], r["label"]) for r in base_vectors(spark, ROOT).collect())
    x, labels = np.array([v for _, v, _ in rows]), np.array([k for *_, k in rows])
    q = np.array([v for _, v in sorted((r["query_id"], r["q"]) for r in query_stream(spark, ROOT).collect())])
    return x, labels, q


def _map(rows):
    """Covariance, its eigenvectors with a positive largest entry, and their product with the roots of the eigenvalues."""
    c = np.cov(rows.T)
    values, vectors = np.linalg.eigh(c)
    for j in range(len(values)):
        if vectors[np.abs(vectors[:, j]).argmax(), j] < 0:
            vectors[:, j] *= -1
    return c @ vectors @ np.diag(np.sqrt(np.maximum(values, 0)))


def _farthest(x, low, high):
    k = min(len(x), max(low, min(high, int(np.ceil(4 * np.log(max(len(x), 2)))))))
    chosen = [0]
    while len(chosen) < k:
        chosen.append(int(np.min([np.linalg.norm(x - x[c], axis=1) for c in chosen], axis=0).argmax()))
    return x[chosen]


def _self_gravity(x, a, k=3, t=0.3):
    d = np.linalg.norm(x[:, None] - a[None], axis=2)
    near = np.argsort(d, 1, kind="stable")
    dc, out = np.mean([row[n[1]] for row, n in zip(d, near)]), []
    for row, n in zip(d, near):
        a0 = a[n[0]]
        out.append(a0 + t * (1 + sum(dc * row[n[1]] / max(row[j] ** 2, 1e-8) * (a[j] - a0) for j in n[1 : k + 1])))
    return np.array(out)


def _query_gravity(x, a, k, t=0.3):
    between = np.linalg.norm(a[:, None] - a[None], axis=2)
    d, dc, out = np.linalg.norm(x[:, None] - a[None], axis=2), between[between > 0].mean(), []
    for v, row in zip(x, d):
        out.append(v + t * (1 + sum(dc / max(row[j] ** 2, 1e-8) * (a[j] - v) for j in np.argsort(row, kind="stable")[:k])))
    return np.array(out)


def _clusters(x, labels):
    names = np.unique(labels)
    c = np.array([x[labels == k].mean(0) for k in names])
    d = np.round(np.linalg.norm(x[:, None] - c[None], axis=2), 9)
    return c, d.argmin(1), d.min(1), np.round(np.linalg.norm(c[:, None] - c[None], axis=2).sum(1), 9)


def _order(x, labels):
    _, own, dist, total = _clusters(x, labels)
    return sorted(range(len(x)), key=lambda i: (total[own[i]], own[i], dist[i], i))


def _got(spark, name):
    return [r["vec_id"] for r in QUERIES[name](spark, ROOT).orderBy("pos").collect()]


def _alike(a, b):
    """Orders whose keys differ by rounding may swap neighbours, no more."""
    place = {x: i for i, x in enumerate(a)}
    return sorted(a) == sorted(b) and np.abs([place[x] - i for i, x in enumerate(b)]).max() <= 2


def _mapped_stack(tables):
    x, _, q = tables
    both = np.vstack([q[::-1], x])  # ids of queries are -1 - query_id, so the last comes first
    return both @ _map(both), len(q)


@pytest.mark.parametrize("name", ["layout_joint_map", "layout_no_vertical"])
def test_joint_map(spark, tables, name):
    z, m = _mapped_stack(tables)
    moved = _self_gravity(z, _farthest(z, 16, 256))[m:]
    assert _alike(_got(spark, name), _order(moved, tables[1]))


def test_query_map(spark, tables):
    x, labels, q = tables
    a = _map(q)
    moved = _query_gravity(x @ a, _farthest(q @ a, 8, 128), len(np.unique(labels)))
    assert _alike(_got(spark, "layout_query_map"), _order(moved, labels))


def test_joint_key(spark, tables):
    z, m = _mapped_stack(tables)
    _, own, dist, total = _clusters(z[m:], tables[1])
    key = np.round(dist + total[own], 9)
    assert _alike(_got(spark, "layout_joint_key"), sorted(range(len(key)), key=lambda i: (key[i], i)))


def test_first_component(spark, tables):
    values, vectors = np.linalg.eigh(np.cov(tables[0].T))
    v = vectors[:, values.argmax()]
    score = tables[0] @ (v if v[np.abs(v).argmax()] > 0 else -v)
    assert _alike(_got(spark, "order_first_component"), sorted(range(len(score)), key=lambda i: (round(score[i], 9), i)))


def test_adaptive_matrix(tables):
    a, want = transforms.adaptive_matrix(np.cov(tables[2].T)), _map(tables[2])
    assert np.allclose(a @ a.T, want @ want.T, atol=1e-9) and np.allclose(a, want, atol=1e-6)


def test_query_layout_is_a_permutation_with_near_blocks(spark, tables):
    rows = QUERIES["query_layout"](spark, ROOT).collect()
    assert sorted(r["vec_id"] for r in rows) == list(range(len(tables[0]))) and sorted(r["pos"] for r in rows) == list(range(len(rows)))
    sizes = {}
    for r in rows:
        sizes[r["cid"]] = sizes.get(r["cid"], 0) + 1
        assert r["page_id"] == r["pos"] // 16
    assert max(sizes.values()) <= 16


def test_equal_sizes(spark, tables):
    x, labels, _ = tables
    base = base_vectors(spark, ROOT).where("vec_id < 101")
    centres = spark.createDataFrame([(i, v) for i, v in enumerate(x[:4].tolist())], "cid long, c array<double>")
    got = {r["vec_id"]: r["cid"] for r in variants.equal_size_labels(base, centres).collect()}
    d = np.round(np.linalg.norm(x[:101, None] - x[None, :4], axis=2), 9)
    room, want = variants.spread_sizes(101, 4), {}
    for i in sorted(range(101), key=lambda i: (i * 2654435761 % 2**32, i)):
        want[i] = next(c for c in np.argsort(d[i], kind="stable") if room[c])
        room[want[i]] -= 1
    assert got == want and variants.spread_sizes(101, 4) == [26, 25, 25, 25]


# --- the tree of cuts, by a plain greedy ---------------------------------------------------------------------------


def _plain_tree(rows, cuts, queries, k):
    """rows: {column: values}. Leaves as sorted lists of row numbers."""
    n = len(next(iter(rows.values())))
    least, leaves = (n // k) // 2, [np.arange(n)]
    level = leaves[:]

    def meets(part, q):
        return all((lo is None or rows[c][part].max() >= lo) and (hi is None or rows[c][part].min() <= hi) for c, (lo, hi) in q.items())

    order = {id(level[0]): 0}
    while level and len(leaves) < k:
        grown = []
        for part in sorted(level, key=lambda p: (-len(p) * sum(meets(p, q) for q in queries), order[id(p)])):
            if len(leaves) >= k or len(part) < 2 * least:
                continue
            own, best, chosen = [q for q in queries if meets(part, q)], 0.99, None
            for c, x in cuts:
                sides = part[~(rows[c][part] > x)], part[rows[c][part] > x]
                if min(map(len, sides)) < max(1, least):
                    continue
                score = sum(len(s) for q in own for s in sides if meets(s, q)) / (len(part) * len(own)) if own else 1.0
                if score < best * (0.99 if chosen is not None else 1):
                    best, chosen = score, sides
            if chosen is not None:
                leaves = [p for p in leaves if p is not part] + list(chosen)
                for s in chosen:
                    order[id(s)] = len(order)
                grown += chosen
        level = grown
    return leaves


def test_tree_is_the_plain_greedy(spark):
    lines = spark.read.parquet(f"{ROOT}/lineitem.parquet").select(*PP.COLUMNS).toPandas()
    rows = {c: lines[c].to_numpy() for c in PP.COLUMNS}
    queries = [{"l_quantity": (10.0, 20.0)}, {"l_discount": (None, 0.03), "l_quantity": (40.0, None)}, {"l_extendedprice": (None, 20000.0)}]
    cuts = [("l_quantity", 9.0), ("l_quantity", 20.0), ("l_quantity", 39.0), ("l_discount", 0.03), ("l_extendedprice", 20000.0)]
    want = sorted((len(p), *((rows[c][p].min(), rows[c][p].max()) for c in PP.COLUMNS)) for p in _plain_tree(rows, cuts, queries, 6))
    got = sorted((r["size"], *((r[f"{c}_lo"], r[f"{c}_hi"]) for c in PP.COLUMNS)) for r in QUERIES["qd_tree_leaves"](spark, ROOT).collect())
    assert got == want
    _, tree = PP._tree(spark, ROOT)
    again = P.Node.from_dict(tree.to_dict())
    assert again.to_dict() == tree.to_dict() and len(tree.lines()) == 2 * len(tree.leaves()) - 1


# --- streams ----------------------------------------------------------------------------------------------------------


def test_reservoirs_hold_at_most_k_of_the_key(spark):
    events = {}
    for r in spark.read.parquet(f"{ROOT}/events.parquet").select("user_id", "event_id").collect():
        events.setdefault(r["user_id"], set()).add(r["event_id"])
    got = QUERIES["stream_reservoirs"](spark, ROOT).collect()
    assert {r["user_id"] for r in got} == set(events)
    for r in got:
        sample = {int(x) for x in r["sample"].split()}
        assert len(sample) == r["size"] <= 8 and sample <= events[r["user_id"]] and r["size"] >= min(len(events[r["user_id"]]), 8) - 1


def test_pool_switches_follow_the_policy(spark):
    """The sticky policy over the pooled families, walked by hand."""
    families = {}
    from pageloom.plans import reports

    for r in reports._pool_families(spark, ROOT).collect():
        families.setdefault(r["window_id"], []).append(r)
    previous, want = None, []
    for w in sorted(families):
        options = families[w]
        if previous is None:
            chosen = next(o for o in options if o["layout_label"] == "base")
        else:
            stay = min(options, key=lambda o: (o["layout_label"] != previous, o["query_cost"], o["candidate_id"]))
            best = min(options, key=lambda o: (o["query_cost"] + o["movement_cost"], o["candidate_id"]))
            chosen = best if best["layout_label"] != stay["layout_label"] and stay["query_cost"] - best["query_cost"] > 0.05 else stay
        want.append((w, chosen["candidate_id"]))
        previous = chosen["layout_label"]
    assert sorted((r["window_id"], r["chosen_candidate_id"]) for r in QUERIES["switch_on_pool"](spark, ROOT).collect()) == want


def test_phased_counters(spark):
    """Counters fill, full ones are out, and a phase ends when all are full: walked over the events' costs by hand."""
    from pageloom.plans import workload

    costs = {}
    for r in workload._state_costs(spark, ROOT).collect():
        costs.setdefault(r["window_id"], {})[r["state"]] = r["cost"]
    counter, current, draws, want = {s: 0.0 for s in range(4)}, 0, 0, []
    for w in sorted(costs):
        counter = {s: c + costs[w][s] for s, c in counter.items()}
        moved = False
        if counter[current] >= 2000.0:
            left, held = [s for s in range(4) if counter[s] < 2000.0], dict(counter)
            if not left:
                counter = dict.fromkeys(counter, 0.0)
                left = [current] if held[current] <= sum(held.values()) / 4 + 1e-3 else list(range(4))
            c = [held[s] + 1e-3 for s in left]
            gap = [max(c) - x for x in c]
            weight = [g / (sum(gap) + 1e-3) for g in gap]
            p = [x / sum(weight) for x in weight] if sum(weight) > 0 else [1 / len(c)] * len(c)
            draws += 1
            u, upto = ((draws * 2654435761 + 5 * 40503) % 1000003 + 1) / 1000005.0, 0.0
            for s, x in zip(left, p):
                upto += x
                if upto >= u * sum(p):
                    moved, current = s != current, s
                    break
        want.append((w, current, moved))
    got = sorted((r["window_id"], r["state"], r["switched"]) for r in QUERIES["phased_trace"](spark, ROOT).collect())
    assert got == want and any(m for *_, m in want)


def test_hilbert_neighbours_touch():
    """Along the curve every step goes to a neighbouring cell, and every cell is met once."""
    for dims, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        grid = np.array(np.meshgrid(*[np.arange(side)] * dims, indexing="ij")).reshape(dims, -1).T
        walk = grid[np.argsort(transforms.hilbert_binary(grid, bits))]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
