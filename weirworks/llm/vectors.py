"""What the two vector searches share: vectors in blocks, queries brought to every block, the best of all blocks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirworks.llm.common import col
from weirworks.session import cut_lineage

BLOCK_ROWS, CHUNK_ROWS = 8_192, 4_096
FOUND = "query_id long, vec_id long, score {score}, block int"


def sound(df: DataFrame, vec_id: str, vector: str, zero: bool) -> DataFrame:
    """vec_id, vector (array<double>) of the rows that take part: no null ids, no null or non-finite components.

    Empty vectors are left out, and without ``zero`` also those that are all zero.
    """
    v = col(df, vector).cast("array<double>")
    # A NaN is greater than infinity, so one comparison finds both.
    ok = F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & (F.size(v) > 0)
    if not zero:
        ok = ok & F.exists(v, lambda x: x != 0)
    rows = df.select(col(df, vec_id).cast("long").alias("vec_id"), v.alias("vector"), ok.alias("ok"))
    return rows.where("ok AND vec_id IS NOT NULL").drop("ok")


def search(
    rows: DataFrame,
    is_query: Column,
    in_block: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
    k: int,
    score: str,
    block_rows: int = BLOCK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of each query, best first, ties to the smaller vec_id.

    Rows fall into blocks and queries into chunks by a hash of the id, so both are even whatever the data. Each block
    meets each chunk in a task of bounded size: ``in_block(ids, vectors, query ids, query vectors)`` gives the number
    of the query, the id and the score of up to ``k`` rows per query. Vectors meet vectors of their own length only.
    """
    rows = cut_lineage(rows)
    queries = rows.where(is_query)
    counts = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks, chunks = max(1, -(-counts[0] // block_rows)), max(1, -(-counts[1] // chunk_rows))
    here = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    chunk = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(chunks)).cast("int").alias("chunk")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("vector").alias("size")
    left = rows.select("vec_id", "vector", size, here, every(chunks).alias("chunk"))
    right = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), size, chunk, every(blocks).alias("block"))
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(key: tuple, block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(asked):
            return pd.DataFrame({n: [] for n in names})
        block, asked = block.sort_values("vec_id", kind="stable"), asked.sort_values("query_id", kind="stable")
        query_ids = asked["query_id"].to_numpy()
        at, ids, scores = in_block(block["vec_id"].to_numpy(), np.stack(block["vector"]), query_ids, np.stack(asked["query"]))
        return pd.DataFrame({"query_id": query_ids[at], "vec_id": ids, "score": scores, "block": np.int32(key[1])})

    keys = ["size", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, FOUND.format(score=score))
    order = [F.desc("score"), F.asc("vec_id")]
    # Many blocks are merged in two steps, so that no query gathers k rows of each block in one place.
    first = Window.partitionBy("query_id", F.col("block") % max(1, round(blocks**0.5))).orderBy(*order)
    if blocks > 64:
        found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("rank")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= kth)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def gathered(parts: Sequence[tuple[int, np.ndarray, np.ndarray]], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, ids, scores) per query, as three columns."""
    at = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]).astype(np.int64)
    none = [np.array([], np.int64)]
    return at, np.concatenate([p[1] for p in parts] or none), np.concatenate([p[2] for p in parts] or none).astype(kind)
