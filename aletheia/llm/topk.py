"""Exact top-k search by columnar branch-and-bound.

Candidates and queries are dealt into bounded blocks, and each (candidate
block, query block) pair is one group.  In a group the candidates lie in
vertical layout (a row per dimension).  Scores are summed a block of dimensions
at a time; the mass that remains bounds what is still to come
(|q_rest| * |c_rest|), so a candidate whose best case is below the k-th best
worst case of a query is dropped and the survivors are compacted.

Scores are integer inner products; ties go to the smaller id.  Vectors null or
holding null or non-finite components take no part; vectors meet only vectors
of their own number of dimensions; of rows that repeat an id the smallest
vector stands.  Empty vectors score 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 4096
DIM_BLOCK = 16
SCALE = 256


def clean_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(vec_id, v, dim)``: floor(scale * x) as double per component, ids distinct."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).select(
        "vec_id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("v"), F.size("v").alias("dim")
    )


def _best(q: np.ndarray, q_id: np.ndarray, c: np.ndarray, c_id: np.ndarray, k: int, step: int = DIM_BLOCK):
    """Top k of one block pair.  ``c`` is (dimensions, candidates)."""
    dims = c.shape[0]
    most = max(np.abs(q).max(initial=0.0), 1.0) * max(np.abs(c).max(initial=0.0), 1.0) * max(dims, 1)
    if most >= 2.0**53:  # doubles would round: whole numbers of any size
        q, c = q.astype(object).astype(int).astype(object), c.astype(object).astype(int).astype(object)
        exact = True
    else:
        exact = False
    ends = list(range(step, dims, step)) + [dims]
    if not exact:
        mass = lambda a, ax: np.sqrt((a * a).sum(axis=ax))
        c_rest = [mass(c[e:], 0) for e in ends]
        q_rest = [mass(q[:, e:], 1) for e in ends]
    out = []
    first = q[:, : ends[0]] @ c[: ends[0]] if len(ends) > 1 and not exact else None
    for i in range(len(q)):
        own = np.flatnonzero(c_id != q_id[i])
        if exact or first is None:
            score, alive = (q[i] @ c if dims else np.zeros(c.shape[1]))[own], own
        else:
            alive, score, at = own, first[i][own], ends[0]
            for n, e in enumerate(ends):
                if n:
                    score = score + q[i, at:e] @ c[at:e, alive]
                    at = e
                if len(alive) > k and e < dims:
                    slack = q_rest[n][i] * c_rest[n][alive] * (1 + 1e-9) + 1e-6
                    floor = np.partition(score - slack, -k)[-k]
                    stay = score + slack >= floor
                    alive, score = alive[stay], score[stay]
        if exact:
            order = sorted(range(len(alive)), key=lambda j: (-int(score[j]), c_id[alive[j]]))[:k]
        else:
            order = np.lexsort((c_id[alive], -score))[:k]
        out += [(int(q_id[i]), int(c_id[alive[j]]), max(-(2**63), min(2**63 - 1, int(score[j])))) for j in order]
    return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``; both sides as ``clean_vectors`` gives
    them.  Every group holds one bounded block of either side."""
    if k < 1:
        raise ValueError("k must be positive")
    tasks = candidates.sparkSession.sparkContext.defaultParallelism
    n_c, n_q = candidates.count(), queries.count()
    cells_c = max(-(-n_c // CANDIDATE_BLOCK), min(tasks, -(-n_c // 256)), 1)
    cells_q = max(-(-n_q // QUERY_BLOCK), 1)
    cell = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = candidates.withColumn("cc", cell(cells_c)).withColumn("qc", every(cells_q))
    q = queries.withColumn("qc", cell(cells_q)).withColumn("cc", every(cells_c))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            a = np.array(left["v"].tolist(), float).reshape(len(left), -1)
            b = np.array(right["v"].tolist(), float).reshape(len(right), -1)
            rows = _best(b, right["vec_id"].to_numpy(), np.ascontiguousarray(a.T), left["vec_id"].to_numpy(), k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = c.groupBy("dim", "cc", "qc").cogroup(q.groupBy("dim", "cc", "qc")).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k_search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """Rows of ``vectors`` for which ``is_query`` holds (over ``vec_id``) against all others."""
    rows = clean_vectors(vectors)
    return top_k(rows, rows.where(is_query), k)
