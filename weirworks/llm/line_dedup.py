"""Line deduplication that can be taken back: sharded cuckoo filters in front of exact reference counts.

The state is a folder of Parquet tables. ``lines`` holds one row per document and line key (the exact references),
``gone`` the documents that were deleted, ``filters`` one cuckoo filter per shard and batch. A new batch asks the
filters first: a key that no filter knows is new, so only the few others are looked up among the references.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirworks.llm.common import BLANKS, LAST_ID, col, fresh, text_or_empty
from weirworks.llm.cuckoo import CuckooFilter, filled
from weirworks.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10
KEYS_PER_SHARD = 200_000
BATCHES = 3  # in which a whole corpus is taken in, so that all but the first ask the filters
FOUND = "key binary, refs long, first_doc long, last_doc long, known boolean, made int, shards int, shard int, slots binary"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, in ASCII lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _digest(key: Column) -> Column:
    return F.unhex(F.md5(key))


def _number(keys: pd.Series) -> np.ndarray:
    """The first eight bytes of each key digest."""
    return np.frombuffer(b"".join(bytes(k[:8]) for k in keys), np.uint64)


class LineIndex:
    """References of lines to documents, for ``insert``, ``delete`` and ``clean``.

    A document is known by its id; rows that share an id count as one document, and all rows without an id as one
    more that comes after all others. Texts that are null or empty are one empty line. Keys under ``min_chars`` code
    points are never dropped. A key is its MD5 digest. Steps write new files only and a batch counts once all its
    tables are there, so a job that dies can be run again.

    Every batch is counted and cut into so many shards that the keys of one fit a task, a power of two and never fewer
    than before; ``expected_keys`` sets the least number. The filters of a batch keep its number of shards: a later batch with more
    shards asks each of them from several tasks.
    """

    def __init__(self, spark: SparkSession, root: str, min_chars: int = MIN_CHARS, expected_keys: int | None = None):
        self.spark, self.root, self.min_chars = spark, root.rstrip("/"), min_chars
        self.shards = self._shards_for(expected_keys or 1)
        self.batches: list[int] = []
        self.deletions: list[int] = []
        self.filter_steps: list[int] = []

    @staticmethod
    def _shards_for(keys: int) -> int:
        return 1 << max(0, -(-keys // KEYS_PER_SHARD) - 1).bit_length()

    def _read(self, name: str, steps: list[int]) -> DataFrame:
        return reduce(
            DataFrame.unionByName,
            [self.spark.read.parquet(f"{self.root}/{name}/{s}").withColumn("step", F.lit(s)) for s in steps],
        )

    def _next(self) -> int:
        return 1 + max([-1, *self.batches, *self.deletions])

    def _answers(self) -> DataFrame:
        """What the batches found out about their keys."""
        return self._read("filters", self.filter_steps).where("slots IS NULL").drop("step")

    def _filters(self) -> DataFrame:
        return self._read("filters", self.filter_steps).where("slots IS NOT NULL").select("made", "shards", "shard", "slots")

    @staticmethod
    def _shard(shards: Column) -> Column:
        return F.pmod(F.xxhash64("key"), shards).cast("int")

    def live(self) -> DataFrame:
        """References (doc_id, key) of the documents that were not deleted after they came in."""
        lines = self._read("lines", self.batches)
        if self.deletions:
            gone = self._read("gone", self.deletions).groupBy("doc_id").agg(F.max("step").alias("until"))
            lines = lines.join(gone, "doc_id", "left").where("until IS NULL OR step > until").drop("until")
        return lines

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        """Take in documents whose ids are not held yet."""
        step = self._next()
        number = F.coalesce(col(docs, doc_id).cast("long"), F.lit(LAST_ID))
        lines = F.transform(F.split(text_or_empty(docs, text), "\n", -1), line_key)
        long_lines = F.array_distinct(F.filter(lines, lambda key: F.length(key) >= self.min_chars))
        keyed = docs.select(number.alias("doc_id"), F.explode(long_lines).alias("key"))
        keyed.withColumn("key", _digest(F.col("key"))).write.parquet(f"{self.root}/lines/{step}")
        batch = self.spark.read.parquet(f"{self.root}/lines/{step}")
        # One row per key of the batch: a line that a third of all documents share is summed before it moves.
        keys = batch.groupBy("key").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        self.shards = max(self.shards, self._shards_for(batch.count()))
        shards = F.lit(self.shards)
        keys = keys.withColumn("made", F.lit(step)).withColumn("shards", shards).withColumn("shard", self._shard(shards))
        if self.batches:
            # Keys of a shard have the same remainder by any smaller power of two, so they ask one shard of each filter.
            tasks = F.sequence(F.col("shard"), shards - 1, F.col("shards"))
            asked = self._filters().withColumn("shard", F.explode(tasks))
            probed = keys.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(_probe, FOUND)
        else:
            probed = keys.groupBy("shard").applyInPandas(_first_filter, FOUND)
        probed.write.parquet(f"{self.root}/filters/{step}")
        self.batches.append(step)
        self.filter_steps.append(step)

    def repeated(self) -> DataFrame:
        """Keys of at least two live documents: key, refs, first_doc."""
        found = self._answers()
        # A key seen in one document only, and unknown to the filters of all earlier batches, needs no look-up.
        asked = found.where("known OR first_doc < last_doc").select("key").distinct()
        refs = self.live().join(asked, "key", "left_semi")
        counts = refs.groupBy("key").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        return counts.where("first_doc < last_doc").drop("last_doc")

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> None:
        """Forget documents: their references end, and keys that lost the last one leave the filters."""
        step = self._next()
        before = self.live()
        number = F.coalesce(col(ids, doc_id).cast("long"), F.lit(LAST_ID))
        ids.select(number.alias("doc_id")).distinct().write.parquet(f"{self.root}/gone/{step}")
        gone = self.spark.read.parquet(f"{self.root}/gone/{step}")
        touched = before.join(gone, "doc_id", "left_semi").select("key").distinct()
        self.deletions.append(step)
        held = self.live().join(touched, "key", "left_semi").select("key").distinct()
        lost = touched.join(held, "key", "left_anti")
        answers, filters = self._answers(), self._filters()
        # Each filter is asked by itself; where exactly one of all answers to a key, that one loses it.
        sizes = F.array(*[F.lit(1 << n) for n in range(self.shards.bit_length())])
        spread = lost.withColumn("shards", F.explode(sizes)).withColumn("shard", self._shard(F.col("shards")))
        by = ("shards", "shard")
        hits = spread.groupBy(*by).cogroup(filters.groupBy(*by)).applyInPandas(_holders, "key binary, made int, shards int, shard int")
        one = hits.groupBy("key").agg(F.count("*").alias("n"), F.first(F.struct("made", *by)).alias("in")).where("n = 1")
        kept = one.select("key", "in.*").groupBy("made", *by).cogroup(filters.groupBy("made", *by)).applyInPandas(_forget, "made int, shards int, shard int, slots binary")
        names = ("made", "shards", "shard", "slots")
        kept = kept.select(*[F.lit(None).cast(t).alias(c) for c, t in answers.dtypes if c not in names], *names)
        answers.unionByName(kept).write.parquet(f"{self.root}/filters/{step}")
        self.filter_steps = [step]  # this table replaces the earlier ones

    def marks(self) -> DataFrame:
        """Per document the keys that an earlier document holds too: doc_id, drop."""
        again = self.live().join(self.repeated(), "key").where("doc_id > first_doc")
        return again.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))

    def clean(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
        """Documents (all held by the index) without the lines that an earlier document holds too.

        All columns stay, the text is replaced (null only where it was null). ``counts`` names two more columns:
        lines before, and lines dropped.
        """
        key, drop = fresh(docs, "line_doc", "line_drop")
        marks = self.marks().select(F.col("doc_id").alias(key), F.col("drop").alias(drop))
        same = F.coalesce(col(docs, doc_id).cast("long"), F.lit(LAST_ID)) == F.col(key)
        joined = docs.join(marks, same, "left")
        parts = F.split(text_or_empty(joined, text), "\n", -1)
        kept = F.filter(parts, lambda line: ~F.array_contains(F.col(drop), _digest(line_key(line))))
        new = F.when(F.col(drop).isNull(), col(joined, text)).otherwise(F.concat_ws("\n", kept))
        out = [new.alias(c) if c == text else col(joined, c) for c in docs.columns]
        if counts:
            dropped = F.when(F.col(drop).isNull(), 0).otherwise(F.size(parts) - F.size(kept))
            out += [F.size(parts).cast("long").alias(counts[0]), dropped.cast("long").alias(counts[1])]
        return joined.select(*out)


def _rows(keys: pd.DataFrame, known: np.ndarray, made: CuckooFilter | None) -> pd.DataFrame:
    out = keys[["key", "refs", "first_doc", "last_doc", "made", "shards", "shard"]].copy()
    out["known"], out["slots"] = known, None
    if made is not None:
        first = keys.iloc[0]
        last = {"key": None, "refs": None, "first_doc": None, "last_doc": None, "known": None, "slots": made.to_bytes()}
        last |= {c: first[c] for c in ("made", "shards", "shard")}
        out = pd.concat([out.astype(object), pd.DataFrame([last], dtype=object)])
    return out[[c.split()[0] for c in FOUND.split(", ")]]


def _first_filter(keys: pd.DataFrame) -> pd.DataFrame:
    return _rows(keys, np.zeros(len(keys), bool), filled(_number(keys["key"])))


def _probe(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Which keys an earlier batch may hold, and a filter of those that none does."""
    if not len(keys):
        return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})
    hashes = _number(keys["key"])
    known = np.zeros(len(keys), bool)
    for slots in filters["slots"]:
        known |= CuckooFilter.from_bytes(slots).has(hashes)
    return _rows(keys, known, filled(hashes[~known]) if not known.all() else None)


def _holders(lost: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The filters of one shard that answer to the lost keys: a row per key and filter."""
    hashes = _number(lost["key"]) if len(lost) else np.array([], np.uint64)
    parts = [
        lost[CuckooFilter.from_bytes(slots).has(hashes)][["key"]].assign(made=made, shards=shards, shard=shard)
        for made, shards, shard, slots in zip(*(filters[c] for c in ("made", "shards", "shard", "slots")), strict=True)
        if len(hashes)
    ]
    return pd.concat(parts) if parts else pd.DataFrame({"key": [], "made": [], "shards": [], "shard": []})


def _forget(lost: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """One filter without the keys that only it answers to.

    Where several filters answer it cannot be told which one holds the key, so it stays: an entry too many costs a look-up,
    an entry too few would lose a line.
    """
    if not len(lost):
        return filters
    made = [CuckooFilter.from_bytes(s) for s in filters["slots"]]
    for f in made:
        f.remove(_number(lost["key"]))
    return filters.assign(slots=[f.to_bytes() for f in made])


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` without the lines that an earlier one of them holds too, through a new index in the scratch folder.

    They are taken in by BATCHES batches, dealt by a hash of the id (rows without one are in the first); all but the first
    ask the filters of those before, and only keys that a filter knows or two documents share are looked up.
    """
    index = LineIndex(docs.sparkSession, scratch_path(docs.sparkSession, "lines"), min_chars)
    known = col(docs, doc_id)
    batch = F.when(known.isNull(), 0).otherwise(F.pmod(F.xxhash64(known), F.lit(BATCHES)))
    for n in range(BATCHES):
        index.insert(docs.where(batch == n), doc_id, text)
    return index.clean(docs, doc_id, text, counts)
