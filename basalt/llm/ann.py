"""Nearest neighbours by inner product: a block matrix join on int8 tiles with error bounds.

In a tile each vector is x = s q + e with int8 q. The product of the int8 matrices gives
s t <q, r> for a pair, and |<x, y> - s t <q, r>| <= |s q| |e'| + |e| |y|. A candidate whose upper
bound lies below a query's k-th lower bound can't be among its k best; the others are recomputed
from the original vectors in double precision. So the result is exact; int8 only saves work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from basalt.llm.blocks import best, clean
from basalt.llm.common import ship

SLICE = 256  # queries whose scores are held at once
RECOMPUTED = 32 << 20  # bytes of original vectors that are copied at once


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows (as floats, so that BLAS multiplies them), scales, lengths of s q, lengths of the rest."""
    scale = np.maximum(np.abs(x).max(axis=1, initial=0) / 127, np.finfo(np.float64).tiny)
    q = np.rint(x / scale[:, None])
    # products of int8 rows are exact in single precision up to 1,040 components
    q = q.astype(np.float32 if x.shape[1] <= 1040 else np.float64)
    back = q * scale[:, None]
    return q, scale, np.sqrt((back**2).sum(axis=1)), np.sqrt(((x - back) ** 2).sum(axis=1))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def recomputed(x, c, r, col):
    """Inner products of x's rows r with c's rows col, in slices of RECOMPUTED bytes."""
    step = max(1, RECOMPUTED // (16 * max(1, x.shape[1])))
    return np.concatenate([np.zeros(0), *(inner(x[r[i : i + step]], c[col[i : i + step]]) for i in range(0, len(r), step))])


def tile(q_ids, q, c_ids, c, k):
    """Each query's k best candidates (sorted by id) of a tile. Of equal vectors only the first
    k + 1 can matter: the rest have the same score and larger ids."""
    _, group = np.unique(np.ascontiguousarray(c).view(np.dtype((np.void, c.dtype.itemsize * c.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    place = np.empty(len(group), np.int64)
    first = np.searchsorted(group[order], group[order])
    place[order] = np.arange(len(group)) - first
    some = np.flatnonzero(place <= k)
    c_ids, c = c_ids[some], c[some]
    cq, cs, clen, cerr = quantised(c)
    cfull = np.sqrt((c**2).sum(axis=1))
    rows, cols, scores = [], [], []
    for begin in range(0, len(q), SLICE):
        x = q[begin : begin + SLICE]
        xq, xs, xlen, xerr = quantised(x)
        near = (xq @ cq.T).astype(np.float64) * xs[:, None] * cs
        slack = (np.outer(xlen, cerr) + np.outer(xerr, cfull)) * (1 + 1e-9) + 1e-12 * np.outer(xlen + xerr, cfull)
        low, high = near - slack, near + slack
        own = q_ids[begin : begin + SLICE, None] == c_ids
        low[own] = -np.inf
        high[own] = -np.inf
        width = low.shape[1]
        cut = np.partition(low, width - k, axis=1)[:, width - k] if width > k else np.full(len(x), -np.inf)
        r, col = np.nonzero((high >= cut[:, None]) & ~own)
        score = recomputed(x, c, r, col)
        order = np.lexsort((c_ids[col], -score, r))
        r, col, score = r[order], col[order], score[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        rows.append(r[keep] + begin)
        cols.append(some[col[keep]])
        scores.append(score[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by inner product in double precision,
    nearest first, ties to the smaller id.

    is_query: a condition on the column `id`. Rows with null ids and vectors that are null, zero or
    hold null or non-finite components take no part; shorter vectors count as ending in zeros.
    Fewer than k candidates give fewer rows; an empty table none. Repeated rows are candidates each,
    but for more than k + 1 equal vectors of a tile, which can't all be among the k best. Other
    columns are ignored.
    """
    ship(vectors.sparkSession)
    return best(clean(vectors, id_col, vector_col, True), is_query, k, tile, "double")
