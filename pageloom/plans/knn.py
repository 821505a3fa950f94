"""Nearest-neighbour queries over the base vectors."""

from __future__ import annotations

from pageloom.functions import vectors as V
from pageloom.operators import knn
from pageloom.sources.tables import base_vectors, query_stream

_RANKED = """
with q as (select vec_id // 10 as query_id, embedding::double[] as q from embeddings where vec_id % 10 = 0),
d as (select query_id, vec_id, {key} as k, {show} as {name} from q, (select vec_id, embedding::double[] as v from embeddings)),
r as (select *, row_number() over (partition by query_id order by k, vec_id) as rank from d)
select query_id, cast(rank as bigint) as rank, vec_id, round({name}, 6) + 0.0 as {name} from r where rank <= 10
"""


def _knn(metric: str):
    def run(spark, root):
        found = knn.exact(query_stream(spark, root), base_vectors(spark, root), k=10, metric=metric)
        name = knn.METRICS[metric][1]
        return found.withColumn(name, V.round6(found[name]))

    return run


QUERIES = {"knn_exact_l2": _knn("l2"), "knn_cosine": _knn("cosine"), "knn_mips": _knn("ip")}
ORACLES = {
    "knn_exact_l2": _RANKED.format(key="round(list_distance(q, v), 9)", show="list_distance(q, v)", name="distance"),
    "knn_cosine": _RANKED.format(key="-round(list_cosine_similarity(q, v), 9)", show="list_cosine_similarity(q, v)", name="similarity"),
    "knn_mips": _RANKED.format(key="-round(list_inner_product(q, v), 9)", show="list_inner_product(q, v)", name="score"),
}
