"""Queries against all candidates, block by block, for vector operators.

Rows fall into blocks of bounded size by a hash of id and vector. A task gets one block of queries and
one block of candidates and gives each query's best candidates there; heaps merge what the tiles
gave. Rows are copied once for each block on the other side, and nothing is broadcast.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import saved

BLOCK = 4096


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of doubles; shorter vectors end in zeros."""
    column = column.combine_chunks()
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))


def clean(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """id, v: the rows that take part. Null ids, null vectors and vectors with null or non-finite
    components don't, nor, if asked, those of zeros alone."""
    v = F.col("v")
    df = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    df = df.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))))
    return df.where(F.exists(v, lambda x: x != 0)) if nonzero else df


def best(vectors: DataFrame, is_query: Column, k: int, tile, score_type: str, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best of all rows of `vectors` (id, v)
    but those with its own id; ties go to the smaller id.

    is_query: a condition on id. tile(q_ids, q, c_ids, c, k) gives arrays of query rows, candidate
    rows and scores that hold each query's k best of the tile. Repeated rows count each on its own
    as candidates; a repeated query is asked once. Fewer candidates give fewer rows; an empty table
    none.
    """
    # equal rows (id and vector) come to one with a number of copies; more than k + 1 of them can't matter
    equal = vectors.groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k + 1)).alias("copies"))
    vectors = saved(equal.select("id", "v", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")), "vectors")
    n, n_queries = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    c_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-n_queries // block))
    at = lambda blocks, *of: F.pmod(F.xxhash64(*of), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    candidates = vectors.select("id", "v", at(c_blocks, "id", "v", "copy").alias("cb"), every(q_blocks).alias("qb"))
    queries = vectors.where(is_query).dropDuplicates(["id"]).select("id", "v", at(q_blocks, "id", F.lit(2)).alias("qb"), every(c_blocks).alias("cb"))
    kind = pa.float64() if score_type == "double" else pa.int64()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), kind)], names=["query_id", "vec_id", "score"])
        if not left.num_rows or not right.num_rows:
            return empty
        q_ids, c_ids = (t.column("id").to_numpy() for t in (left, right))
        order = np.argsort(c_ids, kind="stable")
        q, c = same_width(matrix(left.column("v")), matrix(right.column("v")))
        rows, cols, scores = tile(q_ids, q, c_ids[order], c[order], k)
        return pa.table([pa.array(q_ids[rows], pa.int64()), pa.array(c_ids[order][cols], pa.int64()), pa.array(scores, kind)], names=["query_id", "vec_id", "score"])

    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(run, f"query_id long, vec_id long, score {score_type}")

    def merge(batches):
        heaps: dict[int, list] = {}
        for batch in batches:
            for query, vec, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heap = heaps.setdefault(query, [])
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))
        for query, heap in heaps.items():
            heap.sort(reverse=True)
            yield pa.RecordBatch.from_arrays([pa.array([query] * len(heap), pa.int64()), pa.array(range(1, len(heap) + 1), pa.int32()), pa.array([-v for _, v in heap], pa.int64()), pa.array([s for s, _ in heap], kind)], names=["query_id", "rank", "vec_id", "score"])

    return found.repartition("query_id").mapInArrow(merge, f"query_id long, rank int, vec_id long, score {score_type}")


def top_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of a row of scores, ties to the first columns."""
    if len(scores) <= k:
        return np.arange(len(scores))
    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > cut)
    return np.concatenate([above, np.flatnonzero(scores == cut)[: k - len(above)]])
