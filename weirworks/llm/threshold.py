"""Exact top-k by Fagin's threshold algorithm over sorted lists, one per dimension.

For a query with component q, a dimension's list goes from the largest to the smallest product with q. All lists are
read to the same depth; what was seen is scored exactly. No vector still unseen can score more than the sum of the
products at that depth, so reading ends when the k-th best score is above this bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.llm.vectors import best, gathered, search, sound

EXACT = 2.0**53


class SortedLists:
    """Integer vectors with their order along every dimension."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(-vectors, axis=0, kind="stable").astype(np.int32)
        self.down = np.take_along_axis(vectors, self.order, axis=0)
        self.largest = float(np.abs(vectors).max())

    def levels(self) -> list[int]:
        """Depths at which the bound is looked at."""
        out = [4]
        while out[-1] < len(self.vectors):
            out.append(out[-1] * 4)
        return [min(t, len(self.vectors)) for t in out]

    def top(self, query: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best vectors; ``own`` is no answer."""
        vectors, small = self.vectors, float(np.abs(query).max()) * self.largest * len(query) < EXACT
        if not small:  # sums of products may not be exact in floating point: whole numbers, and no early end
            vectors, query = np.array([[int(x) for x in row] for row in vectors], object), np.array([int(x) for x in query], object)
        n = len(self.vectors)
        up, falls = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, bool)
        places, scores, before = np.array([], np.int64), np.array([], vectors.dtype), 0
        for depth in self.levels():
            fresh = np.zeros(n, bool)
            fresh[self.order[before:depth][:, up]] = True
            fresh[self.order[n - depth : n - before][:, falls]] = True
            if depth == n:  # also what only dimensions with a zero could show
                fresh[:] = True
            new = np.flatnonzero(fresh & ~seen)
            seen |= fresh
            new_ids = new[ids[new] != own]
            places, scores = np.r_[places, new_ids], np.r_[scores, vectors[new_ids] @ query]
            keep = best(scores, ids[places], k) if small else _best_large(scores, ids[places], k)
            places, scores = places[keep], scores[keep]
            bound = query[up] @ self.down[depth - 1, up] + query[falls] @ self.down[n - depth, falls]
            # Strictly above: an unseen vector that ties with the k-th may have the smaller id.
            if small and len(scores) == k and scores[-1] > bound:
                break
            before = depth
        return ids[places], scores


def _best_large(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def top_scores(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0, **sizes: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of floor(scale * component), all exact.

    Vectors that are null, empty or hold null or non-finite components take no part; zero vectors do. Rows that share
    a query's id are no answers to it. Scores must fit 64-bit integers.
    """

    def in_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray):
        lists = SortedLists(vectors)
        parts = [(q, *lists.top(queries[q], ids, query_ids[q], k)) for q in range(len(queries))]
        return gathered(parts, np.int64)

    rows = sound(df, vec_id, vector, zero=True)
    whole = F.transform("vector", lambda x: F.floor(x * F.lit(scale)).cast("double"))
    return search(rows.withColumn("vector", whole), is_query, in_block, k, "long", **sizes)
