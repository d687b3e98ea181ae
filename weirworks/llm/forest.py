"""Approximate nearest neighbours by largest inner product: a forest of hash prefixes.

Each tree gives a vector a long string of bits, the sides of random planes on which it lies, and keeps the strings in a
sorted array; vectors with a common prefix stand next to each other. A query descends every tree to its longest match
and then shortens the prefixes of all trees together, bit by bit, until they hold enough candidates. These are ranked
by their exact inner products.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from weirworks.llm.vectors import best, gathered, search, sound

TREES, BITS = 32, 24


class Forest:
    """The sorted arrays over one block of vectors.

    The largest inner product is the smallest angle once every vector has got one more component that brings it to
    the length of the longest, and every query a zero.
    """

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11):
        self.vectors, self.trees, self.bits = vectors, trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, trees * bits)).astype(np.float32)
        # Scaled by the largest component first, so that squares stay finite.
        self.unit = max(np.abs(vectors).max(), np.finfo(float).tiny)
        scaled = vectors / self.unit
        squares = (scaled * scaled).sum(axis=1)
        hashes = self._hashes(np.column_stack([scaled, np.sqrt(np.maximum(0, squares.max() - squares))]))
        self.order = np.argsort(hashes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(hashes, self.order, axis=1)

    def _hashes(self, points: np.ndarray) -> np.ndarray:
        """Trees x points."""
        sides = (points.astype(np.float32) @ self.planes > 0).reshape(len(points), self.trees, self.bits)
        return np.ascontiguousarray((sides @ (1 << np.arange(self.bits)[::-1])).T)

    def candidates(self, queries: np.ndarray, wanted: int):
        """For each query the places of its candidates: those of the longest prefixes that hold ``wanted`` entries."""
        scale = np.maximum(np.abs(queries).max(axis=1, keepdims=True), np.finfo(float).tiny)
        hashes = self._hashes(np.column_stack([queries / scale, np.zeros(len(queries))]))
        start = np.zeros((self.trees, len(queries)), np.int64)
        stop = np.full((self.trees, len(queries)), len(self.vectors), np.int64)
        open_ = np.ones(len(queries), bool)
        for cut in range(self.bits):
            if not open_.any():
                break
            low = np.empty((self.trees, int(open_.sum())), np.int64)
            high = np.empty_like(low)
            for t in range(self.trees):
                prefix = hashes[t, open_] >> cut
                low[t] = np.searchsorted(self.sorted[t], prefix << cut)
                high[t] = np.searchsorted(self.sorted[t], (prefix + 1) << cut)
            enough = (high - low).sum(axis=0) >= wanted
            done = np.flatnonzero(open_)[enough]
            start[:, done], stop[:, done] = low[:, enough], high[:, enough]
            open_[done] = False
        for q in range(len(queries)):
            mask = np.zeros(len(self.vectors), bool)
            for t in range(self.trees):
                mask[self.order[t, start[t, q] : stop[t, q]]] = True
            yield np.flatnonzero(mask)


def neighbours(
    df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", share: float = 0.8, least: int = 2_000, **sizes: int
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (a condition on ``vec_id``) the ``k`` nearest rows found.

    In each block the prefixes are shortened until all trees together hold ``share`` of the block's rows, at least
    ``least``. 0.8 over 32 trees looks at about half the rows and finds nine of ten neighbours even among vectors
    without structure; clustered vectors do with far less. Vectors that are null, empty, zero or hold null or
    non-finite components take no part. Rows that share an id are no neighbours of each other.
    """

    def in_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray):
        rough = vectors.astype(np.float32)
        parts = []
        wanted = max(int(share * len(ids)), least)
        for q, places in enumerate(Forest(vectors).candidates(queries, wanted)):
            places = places[ids[places] != query_ids[q]]
            near = rough[places] @ queries[q].astype(np.float32)
            if len(places) > k and np.isfinite(near).all():
                # Single precision only sorts out what is below the k-th by more than its rounding.
                slack = 1e-5 * np.abs(queries[q]).sum() * np.abs(vectors).max()
                places = places[near >= np.partition(near, len(near) - k)[len(near) - k] - slack]
            scores = vectors[places] @ queries[q]
            top = best(scores, ids[places], k)
            parts.append((q, ids[places[top]], scores[top]))
        return gathered(parts, float)

    return search(sound(df, vec_id, vector, zero=False), is_query, in_block, k, "double", **sizes)
