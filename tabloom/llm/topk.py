"""Exact top-k inner products with block-at-a-time pruning.

Vectors are quantised to integers.  They are dealt to groups of bounded size; every group holds blocks
(ranges of vec_id) with a forward index (the block's rows) and the maximum and minimum of every
component.  A query's bound for a block is the sum over components of its value times the maximum
(minimum where its value is negative).  Blocks are visited in descending order of the bound until it
falls below the query's k-th best score; ties go to the smaller id, so a block whose bound equals the
k-th score is still scored.  The k best of every group are merged per query.

Null vectors, vectors with null or non-finite components, and null ids take no part.  Vectors of
another length than the query's are scored over the shorter one's components (missing ones are 0).
Repeated ids are scored row by row; every row but those with the query's own id is a candidate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
GROUP_ROWS = 16_384
QUERY_CHUNK = 256


def quantise(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of every component, usable rows only."""
    v = F.col(vec_col).cast("array<double>")
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
            .select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v")))


def _matrix(vs, width):
    m = np.zeros((len(vs), width))
    for i, v in enumerate(vs):
        m[i, : len(v)] = v
    return m


def search_group(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of one group for each query: (query_id, vec_id, score)."""
    if not len(q) or not len(c):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                             "score": pd.Series(dtype="int64")})
    c = c.sort_values("vec_id", kind="stable")
    width = max(max(map(len, c["v"])), max(map(len, q["v"])))
    ids, x = c["vec_id"].to_numpy(np.int64), _matrix(c["v"].tolist(), width)
    starts = np.arange(0, len(ids), BLOCK)
    high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    out_q, out_v, out_s = [], [], []
    qid_all, qv_all = q["query_id"].to_numpy(np.int64), q["v"].tolist()
    for at in range(0, len(qid_all), QUERY_CHUNK):
        qid, y = qid_all[at: at + QUERY_CHUNK], _matrix(qv_all[at: at + QUERY_CHUNK], width)
        bound = np.maximum(y, 0) @ high.T + np.minimum(y, 0) @ low.T
        order = np.argsort(-bound, axis=1, kind="stable")
        best_s = np.full((len(qid), k), -np.inf)
        best_v = np.full((len(qid), k), np.iinfo(np.int64).max)
        live = np.arange(len(qid))
        for step in range(len(starts)):
            b = order[live, step]
            go = bound[live, b] >= best_s[live, -1]
            live, b = live[go], b[go]
            if not len(live):
                break
            for block in np.unique(b):  # queries that want the same block share one product
                rows = live[b == block]
                lo, hi = starts[block], min(starts[block] + BLOCK, len(ids))
                s = y[rows] @ x[lo:hi].T
                v = np.broadcast_to(ids[lo:hi], s.shape)
                s = np.where(v == qid[rows, None], -np.inf, s)
                s = np.concatenate([best_s[rows], s], axis=1)
                v = np.concatenate([best_v[rows], v], axis=1)
                o = np.lexsort((v, -s), axis=1)[:, :k]
                best_s[rows] = np.take_along_axis(s, o, axis=1)
                best_v[rows] = np.take_along_axis(v, o, axis=1)
        r, j = np.nonzero(np.isfinite(best_s))
        out_q.append(qid[r])
        out_v.append(best_v[r, j])
        out_s.append(best_s[r, j].astype(np.int64))
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v),
                         "score": np.concatenate(out_s)})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` (query_id, v) against ``candidates`` (vec_id, v),
    both quantised.  Every query is sent to every group of candidates; a group and its queries are
    one task of bounded size in candidates."""
    n = candidates.count()
    groups = max(1, -(-n // group_rows))
    cand = candidates.select(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(groups)).alias("g"),
                             "vec_id", "v")
    # query rows are dealt in slices too, so that one task never holds all queries
    nq = queries.count()
    slices = max(1, -(-nq // 8192))
    cand = cand.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    q = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int").alias("s"), "query_id", "v").withColumn(
        "g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
    found = (q.groupBy("g", "s").cogroup(cand.groupBy("g", "s"))
             .applyInPandas(lambda a, b: search_group(a, b, k), "query_id long, vec_id long, score long"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def embeddings_top_k(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    v = quantise(embeddings)
    q = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    return top_k(q, v, k)
