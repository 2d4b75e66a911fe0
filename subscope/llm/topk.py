"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are dealt to blocks of about BLOCK rows and queries to groups of about QUERIES. For a
block and a group, each component is a list of the block's rows in sorted order; a query
reads it from the end its weight's sign favours. All lists are read side by side, to a
fraction of their length at a time (DEPTHS). What a row has not shown yet lies between the
list's far end and the last value read, which gives each row a lower and an upper bound of
its score; these come as matrix products of the clipped block. Reading stops for a query
once few rows outside its k best lower bounds have an upper bound that reaches the k-th of
them; those that remain get their final scores. The k best of every block are then ranked.

Defined results: scores are exact integers. A vector that is null, or has a null or
non-finite component, or a null id, takes no part; a missing last component counts as zero.
Ties go to the smaller id. A query never meets a row with its own id. Fewer than k rows give
as many as there are. Query rows with the same id and vector are one query; different vectors
of one id are queries of their own, each with its ranks from 1 under the same query_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK, QUERIES = 8192, 1024
#: share of every list that is read before the bounds are looked at
DEPTHS = (1 / 16, 1 / 4, 1 / 2)
#: queries whose bounds are held at once
STRIP = 256
#: rows per query, as a multiple of k, that may stay open when reading stops
OPEN = 8


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, vec): floor(scale * x) of every component, rows that take part only."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("vec")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[:len(v)] = v
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.dtype:
    """The smallest type whose products and sums of these rows are exact integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] * 2
    return np.dtype(np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else object)


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query id, row ids, scores, place in ``q``) of the k best rows of the block, by falling score, then id."""
    kind = _exact(q, x)
    q, x = q.astype(kind), x.astype(kind)
    lists = np.sort(x, axis=0)  # each component's list, ascending
    found = []
    for at in range(0, len(q), STRIP):
        part, part_ids = q[at:at + STRIP], q_ids[at:at + STRIP]
        up, down = np.maximum(part, 0), np.minimum(part, 0)
        waiting = np.arange(len(part))
        for depth in DEPTHS if kind != object else ():
            read = int(len(x) * depth)
            if read < k + 1 or not len(waiting):
                continue
            high, low = lists[len(x) - read], lists[read - 1]  # last values read from either end
            most = up[waiting] @ np.maximum(x, high).T + down[waiting] @ np.minimum(x, low).T
            least = up[waiting] @ np.where(x >= high, x, lists[0]).T + down[waiting] @ np.where(x <= low, x, lists[-1]).T
            least[part_ids[waiting][:, None] == ids] = -np.inf
            bar = np.partition(least, len(x) - k, axis=1)[:, len(x) - k]
            open_rows = most >= bar[:, None]
            done = open_rows.sum(1) <= OPEN * k
            for n in np.flatnonzero(done):
                rows = np.flatnonzero(open_rows[n])
                found.append((*_best(part_ids[waiting[n]], ids[rows], x[rows] @ part[waiting[n]], k), at + waiting[n]))
            waiting = waiting[~done]
        if len(waiting):  # the lists read to their ends
            scores = part[waiting] @ x.T
            for n, row in zip(waiting, scores, strict=True):
                if len(row) > k + 1:  # one of the k + 1 best may be the query's own
                    bar = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
                    rows = np.flatnonzero(row >= bar)
                else:
                    rows = np.arange(len(row))
                found.append((*_best(part_ids[n], ids[rows], row[rows], k), at + n))
    return found


def _best(query: int, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    own = ids != query
    ids, scores = ids[own], scores[own]
    if scores.dtype == object:
        scores = np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in scores], np.int64)
    order = np.lexsort((ids, -scores))[:k]
    return query, ids[order], scores[order].astype(np.int64)


def top_k(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 64, block: int = BLOCK, group: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row that ``is_query`` holds for."""
    rows = integer_vectors(df, id_col, vector_col, scale)
    queries = integer_vectors(df.where(is_query), id_col, vector_col, scale).distinct()
    queries = queries.withColumn("key", F.xxhash64("vec"))
    n, m = rows.count(), queries.count()
    blocks, groups = max(1, -(-n // block)), max(1, -(-m // group))
    number = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = rows.select("id", "vec", number(blocks).alias("b"), every(groups).alias("g"))
    right = queries.select("id", "key", "vec", number(groups).alias("g"), every(blocks).alias("b"))

    def run(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out, keys = [], np.zeros(0, np.int64)
        if len(x) and len(q):
            width = max(x.vec.map(len).max(), q.vec.map(len).max())
            out = search(q.id.to_numpy(), _matrix(q.vec, width), x.id.to_numpy(), _matrix(x.vec, width), k)
            keys = q.key.to_numpy()[[f[3] for f in out]]
        return pd.DataFrame({
            "query_id": np.repeat(np.array([f[0] for f in out], np.int64), [len(f[1]) for f in out]),
            "key": np.repeat(keys, [len(f[1]) for f in out]),
            "vec_id": np.concatenate([np.zeros(0, np.int64), *[f[1] for f in out]]),
            "score": np.concatenate([np.zeros(0, np.int64), *[f[2] for f in out]]),
        })

    best = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(run, "query_id long, key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
