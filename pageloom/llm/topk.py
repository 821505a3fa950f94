"""Exact top-k by inner product: columnar branch and bound over vertically stored blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.shared import written

#: Vectors of a candidate block, blocks of a stripe, queries of a query block, dimensions of a step.
BLOCK, STRIPE, QUERIES, STEP = 4096, 4, 512, 16
_EXACT = 2.0**53


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, in double, as longs.

    Rows with a null id or vector, or with a null or non-finite component, are left out.
    """
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(F.coalesce(c, F.lit(float("nan")))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, dims, n, ids, rows, v): blocks of vectors of one length, a dimension's values side by side."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values(["vec_id", "row"], kind="stable")
        dims_of = pdf["v"].map(len)
        for dims, part in pdf.groupby(dims_of, sort=True):
            m = np.array(part["v"].tolist(), np.int64).reshape(len(part), int(dims))
            kind = "<i2" if dims == 0 or abs(m).max(initial=0) < 2**15 else "<i8"
            ids, own = (part[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "row"))
            out.append((int(pdf["block"].iloc[0]), int(dims), kind, ids, own, np.ascontiguousarray(m.T).astype(kind).tobytes()))
        return pd.DataFrame(out, columns=["block", "dims", "kind", "ids", "own", "v"])

    keyed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks)).cast("int"))
    return keyed.groupBy("block").applyInPandas(one, "block int, dims int, kind string, ids binary, own binary, v binary")


class _Best:
    """The k best (score, id) of one query so far."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.empty(0), np.empty(0, np.int64)

    @property
    def least(self) -> float:
        return self.score[-1] if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[order], ids[order]


def _search(q_rows: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, c: np.ndarray, best: list[_Best]) -> None:
    """Adds one block's candidates (dims x n) to the best of each query (rows of q).

    Scores grow step by step of dimensions, those first in which the queries have most mass. After each step a
    candidate can gain at most |rest of q| * |rest of c|; it stays while that reaches the k-th best score known,
    or the k-th best score that candidates of this block are sure of, and the survivors are compacted.
    """
    dims, n = c.shape
    order = np.argsort(-(q**2).sum(0), kind="stable")
    q, c = q[:, order], c[order]
    cuts = [(a, min(a + STEP, dims)) for a in range(0, dims, STEP)] or [(0, 0)]
    rest_q = [np.sqrt((q[:, b:] ** 2).sum(1)) for _, b in cuts]
    rest_c = [np.sqrt((c[b:] ** 2).sum(0)) for _, b in cuts]
    a, b = cuts[0]
    begun = q[:, a:b] @ c[a:b]
    slack = 1e-6 * (1 + np.abs(begun).max(initial=0))
    own = np.isin(c_rows, q_rows)
    for i, (row, found) in enumerate(zip(q_rows.tolist(), best, strict=True)):
        part, at = begun[i], None
        if own.any() and (mine := c_rows == row).any():
            at = np.flatnonzero(~mine)
            part = part[at]
        for step, (a, b) in enumerate(cuts):
            if step:
                part = part + q[i, a:b] @ (c[a:b] if at is None else c[a:b][:, at])
            gain = rest_q[step][i] * (rest_c[step] if at is None else rest_c[step][at])
            sure = found.least
            if len(part) > found.k:
                sure = max(sure, np.partition(part - gain, len(part) - found.k)[len(part) - found.k])
            stay = part + gain >= sure - slack
            if not stay.all():
                part = part[stay]
                at = np.flatnonzero(stay) if at is None else at[stay]
        found.add(part, c_ids if at is None else c_ids[at])


def _read(row, kind=np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, np.int64)
    return ids, np.frombuffer(row.own, np.int64), np.frombuffer(row.v, row.kind).reshape(row.dims, len(ids)).astype(kind)


def _exactly(q_rows, q, c_ids, c_rows, c, best: list[_Best]) -> None:
    """For components too large for exact doubles: Python integers; a score past a long's range is the range's end."""
    for i, (row, found) in enumerate(zip(q_rows.tolist(), best, strict=True)):
        keep = c_rows != row
        score = np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in (q[i] @ c)[keep].tolist()] if keep.any() else [], object)
        found.score = found.score.astype(object)
        ids = np.concatenate([found.ids, c_ids[keep]])
        score = np.concatenate([found.score, score])
        order = sorted(range(len(ids)), key=lambda j: (-score[j], ids[j]))[: found.k]
        found.score, found.ids = score[order], ids[order].astype(np.int64)


def top_k(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with every other vector.

    rows is (vec_id, v) with integer vectors; queries are compared with vectors of their own length. Ties go to
    the smaller id, ranks count from 1. Rows that repeat an id are rows of their own: each is a candidate, for every
    query but itself, and each that is a query has its own k results. Blocks of queries meet stripes of candidate
    blocks, each pair in a task of bounded size. An empty table gives an empty result; scores past a long's range
    are reported as the range's end.
    """
    # numbered once and written: a second evaluation might deal the numbers anew
    rows = written(rows.select("vec_id", "v", F.monotonically_increasing_id().alias("row")), "topk-rows")
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    n_blocks, n_query = max(1, -(-counts["n"] // BLOCK)), max(1, -(-counts["q"] // QUERIES))
    stripes = -(-n_blocks // STRIPE)
    c = _packed(rows, n_blocks).withColumn("stripe", (F.col("block") % stripes).cast("int"))
    c = c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    q = _packed(rows.where(is_query), n_query).withColumnRenamed("block", "qb")
    q = q.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))

    def pair(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        for mine in queries.itertuples():
            q_ids, q_rows, q = _read(mine)
            best = [_Best(k) for _ in q_ids]
            for other in candidates[candidates["dims"] == mine.dims].sort_values("block").itertuples():
                c_ids, c_rows, c = _read(other)
                if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, mine.dims) < _EXACT:
                    for at in range(0, len(q_ids), 64):
                        _search(q_rows[at : at + 64], q.T[at : at + 64], c_ids, c_rows, c, best[at : at + 64])
                else:
                    _exactly(q_rows, _read(mine, object)[2].T, *_read(other, object), best)
            out += [(i, r, j, int(s)) for i, r, b in zip(q_ids.tolist(), q_rows.tolist(), best, strict=True) for j, s in zip(b.ids.tolist(), b.score.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query_id", "row", "vec_id", "score"])

    met = q.groupBy("qb", "stripe").cogroup(c.groupBy("qb", "stripe")).applyInPandas(pair, "query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
