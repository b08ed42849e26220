"""Exact top-k by inner product, with multi-resolution segment statistics as bounds.

A vector is cut into segments; of each the mean and the deviation are kept, for 4 and for 16
segments.  For a segment of L components the squared distance of two vectors is at least
L * ((m1 - m2)^2 + (s1 - s2)^2), so their inner product, half of both squared norms less the
squared distance, is at most L * (m1 * m2 + s1 * s2).  A query drops the candidates whose
bound is below its k-th score so far, first on few segments, then on more, and computes the
exact score of the rest.  Queries and candidates meet in a grid of blocks: each cell keeps
its k best for each query, and the k best of a query's cells are its answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartweave.llm import kernels

LEVELS = (4, 16)
#: Rows of a block of queries and of candidates; a task holds one of each.
QUERY_BLOCK = 100_000
ROW_BLOCK = 200_000
CHUNK = 8192


def _quantised(levels_of: int):
    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            values = vectors.flatten()
            sizes = np.diff(np.asarray(vectors.offsets.to_numpy()))
            x = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * levels_of)
            ids, out = [], []
            at = np.cumsum(sizes) - sizes
            for i, a, n in zip(batch.column("vec_id").to_pylist(), at.tolist(), sizes.tolist()):
                if n and np.isfinite(x[a : a + n]).all():
                    ids.append(i)
                    out.append(x[a : a + n].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"]
            )

    return quantise


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    data, offsets = kernels.buffers(column)
    width = int(offsets[1]) // 8 if len(offsets) > 1 else 0
    return np.frombuffer(data.tobytes(), "<i8").astype(np.float64).reshape(len(offsets) - 1, width)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Mean and deviation of each segment, both times the root of its length."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)[:-1]
    length = np.diff(np.append(cuts, x.shape[1]))
    mean = np.add.reduceat(x, cuts, axis=1) / length
    square = np.add.reduceat(x * x, cuts, axis=1) / length
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate([mean, deviation], axis=1) * np.sqrt(np.tile(length, 2))


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """The ``k`` best rows of ``x`` for each row of ``q``: (query row, row, score) arrays.

    Rows with the query's own id are left out; equal scores go to the smaller id.
    """
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    levels = [(statistics(q, s), statistics(x, s)) for s in LEVELS]
    largest = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1]
    slack = 1e-9 * (largest + 1)
    # Sums of products of whole numbers are exact in a float up to 2**53, beyond it in integers.
    exact_q, exact_x = (q, x) if largest < 2**53 else (q.astype(np.int64), x.astype(np.int64))
    best_at, best = [[] for _ in range(len(q))], [[] for _ in range(len(q))]
    for at in range(0, len(x), CHUNK):
        part = slice(at, min(at + CHUNK, len(x)))
        coarse = levels[0][0] @ levels[0][1][part].T + slack
        for i in range(len(q)):
            floor = best[i][-1] if len(best[i]) == k else -np.inf
            near = at + np.flatnonzero((coarse[i] >= floor) & (ids[part] != q_ids[i]))
            for own, other in levels[1:]:
                near = near[other[near] @ own[i] + slack >= floor]
            if not len(near):
                continue
            scores = np.concatenate([np.asarray(best[i], exact_x.dtype), exact_x[near] @ exact_q[i]])
            where = np.concatenate([np.asarray(best_at[i], np.int64), near])
            top = np.lexsort((where, -scores))[:k]
            best[i], best_at[i] = scores[top], where[top]
    counts = np.array([len(b) for b in best], np.int64)
    pick = np.concatenate([np.asarray(b, np.int64) for b in best_at]) if len(q) else np.zeros(0, np.int64)
    values = np.concatenate([np.asarray(b, exact_x.dtype) for b in best]) if len(q) else np.zeros(0)
    return np.repeat(np.arange(len(q)), counts), ids[pick], values


def _cell(k: int):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [], [], [], []
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("v")), _matrix(right.column("v"))
            q_ids, ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            for at in range(0, len(q), 512):
                i, found, score = search(q[at : at + 512], q_ids[at : at + 512], x, ids, k)
                out[0].append(q_ids[at + i])
                out[1].append(left.column("uid").to_numpy()[at + i])
                out[2].append(found)
                out[3].append(score.astype(np.int64))
        names = ("query_id", "uid", "vec_id", "score")
        return pa.table({n: np.concatenate(o) if o else np.zeros(0, np.int64) for n, o in zip(names, out)})

    return cell


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, levels: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows for each row whose ``vec_id``
    is divisible by ``every``.

    Components become ``floor(levels * x)``; scores are exact as far as a long holds them.  Rows with a null id, a null or empty vector, or
    a null or non-finite component take no part.  Vectors meet those of their own length only.
    Rows that repeat an id are candidates each; a query row that repeats another in full is
    answered once.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = (
        vectors.select("vec_id", "embedding")
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .filter(~F.exists("embedding", lambda c: c.isNull()))
        .select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .mapInArrow(_quantised(levels), "vec_id long, v binary")
        .withColumn("width", F.octet_length("v"))
    )
    n = rows.count()
    n_rows, n_queries = max(1, -(-n // ROW_BLOCK)), max(1, -(-n // (every * QUERY_BLOCK)))
    # Small tables still make enough cells for the cores there are.
    n_rows = max(n_rows, min(spark.sparkContext.defaultParallelism, -(-n // 2000)))
    queries = rows.filter(F.col("vec_id") % every == 0).distinct().withColumn("uid", F.xxhash64("vec_id", "v"))
    q = queries.select(
        "*",
        F.pmod("uid", F.lit(n_queries)).alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("rb"),
    )
    x = rows.select(
        "*",
        F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_rows)).cast("int").alias("rb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))).alias("qb"),
    )
    keys = ["width", "qb", "rb"]
    found = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(
        _cell(k), "query_id long, uid long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id", "uid").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
