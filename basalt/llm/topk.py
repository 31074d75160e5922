"""Exact top-k by inner product over sparse integer rows: exhaustive term-at-a-time accumulation.

A tile keeps postings of its candidates by component: which rows have a weight there, and which.
Component by component, all queries that have a weight scatter its product with the postings into
their dense arrays of scores at once. A partition selects each query's k best; heaps merge the tiles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.blocks import best, clean, top_of
from basalt.llm.common import ship

SLICE = 256  # queries whose score arrays are held at once


def tile(q_ids, q, c_ids, c, k):
    """Each query's k best candidates (sorted by id) of a tile."""
    q, c = q.astype(np.int64), c.astype(np.int64)
    postings = [(rows := np.flatnonzero(w), w[rows]) for w in np.ascontiguousarray(c.T)]
    rows, cols, scores = [], [], []
    for begin in range(0, len(q), SLICE):
        x = q[begin : begin + SLICE]
        total = np.zeros((len(x), len(c)), np.int64)
        for term, (at, weights) in enumerate(postings):
            own = np.flatnonzero(x[:, term])
            if not len(own) or not len(at):
                continue
            added = np.multiply.outer(x[own, term], weights)
            if len(own) == len(x) and len(at) == len(c):
                total += added
            else:
                total[np.ix_(own, at)] += added
        for i, query in enumerate(q_ids[begin : begin + SLICE]):
            others = np.flatnonzero(c_ids != query)
            got = others[top_of(total[i, others], k)]
            rows.append(np.full(len(got), begin + i))
            cols.append(got)
            scores.append(total[i, got])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to the
    smaller id, over rows floor(scale * x) of components x.

    is_query: a condition on the column `id`. Rows with null ids and vectors that are null or hold
    null or non-finite components take no part; zero vectors do, with score 0. Missing components
    count as 0. Fewer than k candidates give fewer rows; an empty table none. Repeated rows are
    candidates each; other columns are ignored. Components have to stay below 2^53 / scale and
    scores below 2^63.
    """
    ship(vectors.sparkSession)
    rows = clean(vectors, id_col, vector_col, False).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    return best(rows, is_query, k, tile, "long")
