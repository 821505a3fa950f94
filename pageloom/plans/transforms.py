"""Queries over vector transforms and the layouts built on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pageloom.functions import vectors as V
from pageloom.operators import pages, stats, transforms
from pageloom.plans.sql import BASE, QUERIES_CTE, farthest, gravity_to
from pageloom.sources.tables import base_vectors, query_stream


def long_form(rows):
    return rows.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", "i", V.round6(F.col("x")).alias("x"))


def gravity_q2d(spark, root):
    return long_form(transforms.gravity(base_vectors(spark, root), "v", transforms.query_anchors(query_stream(spark, root))))


def affine_map(spark, root):
    a = np.fromfunction(lambda i, j: ((i * 7 + j * 3) % 11 - 5) / 10.0, (64, 64))
    return long_form(transforms.linear(base_vectors(spark, root), "v", a, "vec_id"))


def adaptive_trace(spark, root):
    """The trace and the squared norm of the covariance: what does not depend on the choice of eigenvectors."""
    cov = stats.covariance_matrix(query_stream(spark, root), "q", 64)
    values, vectors = transforms.eigen(cov)
    return spark.createDataFrame([(round(float(values.sum()), 6), round(float((values**2).sum()), 6))], "trace double, squares double")


def gravity_selves(spark, root):
    base = base_vectors(spark, root)
    return long_form(transforms.gravity(base, "v", transforms.base_anchors(base), own=True))


def query_layout(spark, root):
    return pages.paged(transforms.query_layout(base_vectors(spark, root), query_stream(spark, root), 64), 16)


def hilbert_order(spark, root):
    return transforms.curve_order(base_vectors(spark, root), 6).select("vec_id", "pos")


def morton_order(spark, root):
    return transforms.curve_order(base_vectors(spark, root), 6, "morton").select("vec_id", "pos")


QUERIES = {f.__name__: f for f in (gravity_q2d, affine_map, adaptive_trace, gravity_selves, query_layout, hilbert_order, morton_order)}
_X = "x as (select vec_id, generate_subscripts(v, 1) as i, unnest(v) as x from base)"
ORACLES = {
    "gravity_q2d": f"with recursive {BASE}, {QUERIES_CTE}, {farthest('anc', 'qs', 'query_id', 'q', 8, 128)}, {gravity_to('g', 'base', 3)} select vec_id, cast(i - 1 as int) as i, round(x, 6) + 0.0 as x from g_x",
    "gravity_selves": f"with recursive {BASE}, {farthest('anc', 'base', 'vec_id', 'v', 16, 256)}, {gravity_to('g', 'base', 3, own=True)} select vec_id, cast(i - 1 as int) as i, round(x, 6) + 0.0 as x from g_x",
    "affine_map": f"with {BASE}, {_X}, j as (select unnest(range(64)) as j) select vec_id, cast(j as int) as i, round(sum(x * ((((i - 1) * 7 + j * 3) % 11 - 5) / 10.0::double)), 6) + 0.0 as x from x, j group by vec_id, j",
    "adaptive_trace": f"with {BASE}, {QUERIES_CTE}, x as (select query_id, generate_subscripts(q, 1) as i, unnest(q) as x from qs), c as (select a.i, b.i as j, covar_samp(a.x, b.x) as c from x a join x b using (query_id) group by 1, 2) select round(sum(c) filter (i = j), 6) as trace, round(sum(c * c), 6) as squares from c",
    "morton_order": "with b as (select vec_id, embedding::double[] as v from embeddings), x as (select vec_id, generate_subscripts(v, 1) as i, unnest(v) as x from b), m as (select i, min(x) as lo, max(x) as hi from x group by i), g as (select vec_id, list(cast(floor((x - lo) / (hi - lo + 1e-12) * 63) as int) order by i desc) as g from x join m using (i) group by vec_id), k as (select vec_id, array_to_string(flatten([[(e >> (5 - b)) & 1 for e in g] for b in range(6)]), '') as k from g) select vec_id, cast(row_number() over (order by k, vec_id) - 1 as bigint) as pos from k",
}
