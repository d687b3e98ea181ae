"""Quality by importance resampling: texts are drawn as if they came from the distribution of good ones.

Two generative models count hashed n-grams, one over texts labelled good, one over all texts. The log importance weight
of a text is the sum of the log ratios of its n-grams. Weights with Gumbel noise, the ``k`` largest of which are taken,
make a draw without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weirworks.llm.common import col
from weirworks.llm.cuckoo import mix
from weirworks.llm.hashing import BASE, CHUNK_BYTES, INVERSE, WORD_BYTES, powers
from weirworks.session import cut_lineage

BUCKETS = 16_384
BLANK_BYTES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# 0 blank, 1 part of a word, 2 other signs.
CLASSES = np.where(BLANK_BYTES, 0, np.where(WORD_BYTES, 1, 2)).astype(np.int8)
UPPER_BYTES = np.array([65 <= b <= 90 for b in range(256)])
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the number of the text that each belongs to.

    N-grams are words and runs of signs, pairs of them, threes of their shapes (small, capital, shouted, sign), and one
    more for every token that repeats the one before.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kinds = CLASSES[data]
    cut = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    start, stop = cut, np.r_[cut[1:], len(data)]
    token = kinds[start] > 0
    start, stop = start[token], stop[token]
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWERED[data] + np.uint64(1)) * powers(len(data), BASE)[: len(data)], out=sums[1:])
    word = mix((sums[stop] - sums[start]) * powers(len(data), INVERSE)[start])
    upper = np.r_[0, np.cumsum(UPPER_BYTES[data])]
    capitals, length = upper[stop] - upper[start], stop - start
    shape = np.where(capitals == 0, 1, np.where((capitals == length) & (length > 1), 2, np.where(capitals == 1, 3, 4))).astype(np.uint64)
    shape = np.where(kinds[start] == 2, mix(word ^ np.uint64(7)), shape)
    two, three = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    pairs = mix(word[:-1] * np.uint64(3) + mix(word[1:]))[two]
    shapes = mix(mix(mix(shape[:-2]) + shape[1:-1]) + shape[2:] + np.uint64(11))[three] if len(shape) > 2 else word[:0]
    again = doc[1:][two & (word[1:] == word[:-1])]
    grams = np.concatenate([word, pairs, shapes, np.full(len(again), 5, np.uint64)])
    docs = np.concatenate([doc, doc[:-1][two], doc[:-2][three] if len(shape) > 2 else doc[:0], again])
    return (grams % np.uint64(BUCKETS)).astype(np.int64), docs


def _parts(texts: pd.Series) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in bytes, about a megabyte at a time, with the number of the first."""
    first, held, size = 0, [], 0
    for n, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        if held and size + len(data) > CHUNK_BYTES:
            yield first, held
            first, held, size = n, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield first, held


def log_ratios(docs: DataFrame, good: DataFrame, doc_id: str = "doc_id", text: str = "text", target_rows: int = 20_000) -> np.ndarray:
    """log P(n-gram | good texts) - log P(n-gram | all texts), per bucket.

    ``good`` holds the ids (column doc_id) of good texts, of which the ``target_rows`` that hash lowest are used; all of
    ``docs`` make up the other model. Both counts are smoothed by half an n-gram. Without good texts all are 0.
    """
    chosen = good.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows)
    chosen = chosen.select(F.col("doc_id").alias("good_id"))
    rows = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("good_id"), "left").select("text", F.col("good_id").isNotNull().alias("good"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            marks = batch["good"].to_numpy(bool)
            for first, part in _parts(batch["text"]):
                buckets, at = _grams(part)
                every += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[marks[first + at]], minlength=BUCKETS)
        yield pd.DataFrame({"bucket": np.arange(BUCKETS), "all": every, "good": target})

    sums = rows.mapInPandas(counted, "bucket int, all long, good long").groupBy("bucket").agg(F.sum("all").alias("all"), F.sum("good").alias("good"))
    table = sums.toPandas()  # one row per bucket
    every, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    every[table["bucket"]], target[table["bucket"]] = table["all"], table["good"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 0.5) / (target.sum() + 0.5 * BUCKETS)) - np.log((every + 0.5) / (every.sum() + 0.5 * BUCKETS))


def weighed(docs: DataFrame, ratios: np.ndarray, doc_id: str = "doc_id", text: str = "text", seed: str = "draw") -> DataFrame:
    """doc_id, log_weight and draw (with Gumbel noise from a hash of the id). Texts that are null or empty weigh 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, part in _parts(batch.column(1).to_pylist()):
                buckets, at = _grams(part)
                out[first : first + len(part)] = np.bincount(at, weights=ratios[buckets], minlength=len(part))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "log_weight"])

    rows = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).cast("string").alias("text"))
    scored = rows.mapInArrow(run, StructType([rows.schema["doc_id"], StructField("log_weight", DoubleType())]))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10)
    chance = (bits.cast("double") + 0.5) / F.lit(float(2**48))
    return scored.withColumn("draw", F.col("log_weight") - F.ln(-F.ln(chance)))


def top_rows(scored: DataFrame, k: int, by: str, ties: str, bins: int = 4096, sortable: int = 100_000) -> DataFrame:
    """The ``k`` rows with the largest ``by``, ties to the smaller ``ties``, without sorting all rows.

    Rows are counted in ranges of ``by``; the range in which the k-th row falls is cut finer until few enough rows are
    left in it, and only these are sorted.
    """
    value = F.col(by)
    low, high, rows = scored.agg(F.min(by), F.max(by), F.count("*")).first()
    if rows <= k:
        return scored
    above, need = F.lit(False), k
    inside = F.lit(True)
    while rows > sortable and high > low:
        # Ranges are compared by their number everywhere, so rounding can't put a row in two of them.
        bin_ = F.least(F.lit(bins - 1), F.floor((value - F.lit(low)) / F.lit(high - low) * bins))
        counts = scored.where(inside).groupBy(bin_.alias("bin")).agg(F.count("*").alias("rows"), F.min(by).alias("low"), F.max(by).alias("high"))
        for r in sorted(counts.collect(), key=lambda r: -r["bin"]):  # at most ``bins`` rows
            if r["rows"] > need:
                break
            need -= r["rows"]
        above = above | (inside & (bin_ > r["bin"]))
        inside = inside & (bin_ == r["bin"])
        rows, low, high = r["rows"], r["low"], r["high"]
    last = scored.where(inside).orderBy(F.desc(by), ties).limit(need)
    return scored.where(above).unionByName(last)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, log_weight and draw of the documents that are taken.

    ``share`` of all rows is taken, by default the share of good labels among all labels; without labels every row is.
    Labels other than 0 and 1, and labels without an id, are ignored. Rows that share an id have the same noise and are taken by their own
    weights. Nulls: a text counts as empty, a row without an id takes part like any other.
    """
    known = labels.where(col(labels, label).isin(0, 1)).select(col(labels, doc_id).alias("doc_id"), col(labels, label).alias("good"))
    known = known.where("doc_id IS NOT NULL")
    if share is None:
        mean = known.agg(F.avg("good")).first()[0]
        share = 1.0 if mean is None else mean
    ratios = log_ratios(docs, known.where("good = 1"), doc_id, text)
    scored = cut_lineage(weighed(docs, ratios, doc_id, text))
    return top_rows(scored, round(share * scored.count()), "draw", "doc_id")
