"""Exact top-k inner products by Fagin's threshold algorithm.

Queries and candidates are dealt into blocks, and each pair of blocks is one task. In it
every dimension has its list of candidates in order. All lists are read from both ends at
the same pace: what a list shows next bounds the component of any candidate not yet seen,
so the sum of these bounds, times the query, bounds its score. A query stops when its k-th
score is above that bound. Candidates met on the way are scored against all queries that
still run, as one matrix product. The best of each task are merged by a ranking per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.stages import prepared, staged

K = 5
SCALE = 256
CANDIDATES = 2048
QUERIES = 1024
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component as a double without a fraction, whatever its
    size; NULL if a component is NULL or not finite, or if there is none. Raises on a finite
    component that ``scale`` takes beyond all doubles."""
    limit = F.lit(float("inf"))
    doubles = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & (F.size(vector) > 0)

    def scaled(x: Column) -> Column:
        y = scale * x
        whole = F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # no fraction from there on
        return F.when(F.abs(y) < limit, whole).otherwise(F.raise_error(F.lit("a component is too large to be scaled")).cast("double"))

    return F.when(F.coalesce(sound, F.lit(False)), F.transform(doubles, scaled))


def threshold_topk(ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query (with the id that it must not find) the best of the candidates, in
    the order of their ids: query, candidate, score of each result."""
    n, m = len(vectors), len(queries)
    bound = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1] * (n + 1)
    kind = np.float64 if bound < EXACT else object
    exact = np.frompyfunc(int, 1, 1) if kind is object else np.asarray
    x, q = exact(vectors).astype(kind), exact(queries).astype(kind)
    lists = np.sort(x, axis=0)
    rank = np.empty(vectors.shape, np.int64)
    np.put_along_axis(rank, np.argsort(vectors, axis=0, kind="stable"), np.arange(n)[:, None], axis=0)
    depth = np.minimum(rank, n - 1 - rank).min(axis=1)
    met = np.argsort(depth, kind="stable")
    upto = np.searchsorted(depth[met], np.arange(n + 2))
    # score and place in one number: a greater one is a better result
    none = -int(bound) * 4 if kind is object and np.isfinite(bound) else -(1 << 4096) if kind is object else -np.inf
    best = np.full((m, k), none, kind)
    running = np.arange(m)
    at, step = 0, 1
    while at < n and len(running):
        new = met[upto[at] : upto[min(at + step, n)]]
        if len(new):
            score = (q[running] @ x[new].T) * n + (n - 1 - new)
            score = np.where(ids[new][None, :] == own[running][:, None], none, score)
            both = np.concatenate((best[running], score), axis=1)
            both = np.sort(both, axis=1)[:, -k:] if kind is object else np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            best[running] = both
        at, step = min(at + step, n), step * 2
        if at < n:
            high, low = lists[n - 1 - at], lists[at]
            most = np.maximum(q[running] * high, q[running] * low).sum(axis=1)
            # floor of the worst result kept is its score
            running = running[~(best[running].min(axis=1) >= (most + 1) * n)]
    query, column = np.nonzero(best > none)
    found = best[query, column] if kind is object else best[query, column].astype(np.int64)
    return query, (n - 1 - found % n).astype(np.int64), found // n


def _beyond(score: int) -> str:
    """The order of scores at or beyond the ends of a long, as text; empty for others."""
    if LEAST < score < MOST:
        return ""
    digits = str(abs(score))
    key = f"{len(digits):05d}{digits}"
    return key if score > 0 else key.translate(str.maketrans("0123456789", "9876543210"))


def _cell(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("beyond", pa.string())])

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return schema.empty_table()
        candidates = candidates.sort_by("id")
        ids, own = candidates.column("id").to_numpy(), queries.column("query_id").to_numpy()
        size = len(candidates.column("v")[0])
        x = candidates.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size)
        q = queries.column("v").combine_chunks().flatten().to_numpy().reshape(-1, size)
        query, found, score = threshold_topk(ids, x, own, q, k)
        ends = [_beyond(v) for v in score] if score.dtype == object else np.full(len(score), "", object)
        columns = (own[query], queries.column("query_key").to_numpy()[query], ids[found], score.clip(LEAST, MOST).astype(np.int64), ends)
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema)

    return run


def exact_topk(
    rows: DataFrame, queries: Column, id_column: str = "vec_id", vector_column: str = "embedding",
    k: int = K, scale: int = SCALE, candidates: int = CANDIDATES, per_block: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, id, score``: for the rows that satisfy ``queries`` (a condition on
    the id column) the ``k`` other rows with the highest inner product of the quantised
    vectors; ties go to the smaller id.

    Rows take no part whose id or vector is NULL, or whose vector is empty or holds NULL or
    a component that is not finite. Vectors are compared with those of their length only. A
    repeated row counts once; a query does not find rows with its own id. Scores are compared
    exactly, however large; one beyond a long is given as the nearest long. Other columns are
    ignored, an empty table gives an empty result.
    """
    prepared(rows.sparkSession)
    kept = rows.select(F.col(f"`{id_column}`").cast("long").alias(id_column), quantised(F.col(f"`{vector_column}`"), scale).alias("v"), queries.alias("asks"))
    kept = staged(kept.where(F.col(id_column).isNotNull() & F.col("v").isNotNull()).distinct(), "topk-vectors")
    n, asked = kept.agg(F.count("*"), F.sum(F.col("asks").cast("long"))).first()
    rows_blocks, query_blocks = max(1, -(-n // candidates)), max(1, -(-(asked or 0) // per_block))

    def blocks(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def dealt(count: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), id_column), F.lit(count)).cast("int")

    own = kept.where("asks").select(
        F.col(id_column).alias("query_id"), F.xxhash64("v").alias("query_key"), "v", F.size("v").alias("size"), dealt(query_blocks, 1).alias("qb"), blocks(rows_blocks).alias("cb")
    )
    others = kept.select(F.col(id_column).alias("id"), "v", F.size("v").alias("size"), dealt(rows_blocks, 2).alias("cb"), blocks(query_blocks).alias("qb"))
    cell = ["size", "qb", "cb"]
    found = own.groupBy(*cell).cogroup(others.groupBy(*cell)).applyInArrow(_cell(k), "query_id long, query_key long, id long, score long, beyond string")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.desc("beyond"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
