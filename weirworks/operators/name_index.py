"""Ranked search over names from an inverted index of letters.

Whatever way a query matches a text (as a part, by its letters in order, or with typos), they share letters: a match without
typos holds every letter of the query as often as the query does, and a word with d typos lacks at most d of them and is
at most d letters longer or shorter. So texts are listed under their letters ("e" and, with two of them, "e2"), a
search reads only the lists of the query's letters, counts, and scores the rows of the few texts that can match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirworks.functions import search
from weirworks.session import scratch_path

PART = "_part"


def _letters(text: str) -> list[str]:
    """The letters of a text with their count so far: ``see`` is s1, e1, e2. A space is a letter too."""
    seen: dict[str, int] = {}
    out = []
    for ch in text.replace(" ", "_"):
        seen[ch] = seen.get(ch, 0) + 1
        out.append(f"{ch}{seen[ch]}")
    return out


def _letter_column(text: Column) -> Column:
    chars = F.filter(F.split(F.replace(text, F.lit(" "), F.lit("_")), ""), lambda c: c != "")
    before = lambda c, n: F.size(F.filter(F.slice(chars, 1, n + 1), lambda x: x == c))
    return F.transform(chars, lambda c, n: F.concat(c, before(c, n).cast("string")))


@dataclass(frozen=True)
class NameIndex:
    """Three written tables: ``lists`` (letter, unit, size) by letter, ``members`` (unit, id) and ``rows`` by parts of a hash."""

    spark: SparkSession
    path: str
    parts: int

    @classmethod
    def build(cls, df: DataFrame, row_id: str, name: str, kind: str, keywords: str | None = None, path: str | None = None) -> NameIndex:
        """Index ``df`` (unique ``row_id``). A null name or kind is an empty text; ``keywords`` is an array column."""
        spark = df.sparkSession
        path = path or scratch_path(spark, "names")
        parts = min(1024, int(spark.conf.get("spark.sql.shuffle.partitions")))
        words = F.coalesce(F.col(f"`{keywords}`"), F.array().cast("array<string>")) if keywords else F.array().cast("array<string>")
        rows = df.select(
            F.col(f"`{row_id}`").alias("id"),
            F.coalesce(F.col(f"`{name}`"), F.lit("")).alias("name"),
            F.coalesce(F.col(f"`{kind}`"), F.lit("")).alias("kind"),
            F.filter(words, lambda w: w.isNotNull()).alias("words"),
        )
        n, t, k = search.plain_column(F.col("name")), search.plain_column(F.col("kind")), F.transform("words", search.plain_column)
        # Everything a query is held against: the whole name and kind, the words of the name, the kind in one word, the keywords.
        units = F.array_distinct(F.concat(F.array(n, t, F.replace(t, F.lit(" "), F.lit(""))), F.split(n, " "), k))
        members = rows.select("id", F.explode(units).alias("unit"))
        cls._write(members, "unit", f"{path}/members", parts)
        cls._write(rows, "id", f"{path}/rows", parts)
        held = spark.read.parquet(f"{path}/members").select("unit").distinct()
        lists = held.select("unit", F.length("unit").alias("size"), F.explode(_letter_column(F.col("unit"))).alias("letter"))
        lists.repartition(F.col("letter")).write.partitionBy("letter").parquet(f"{path}/lists")
        return cls(spark, path, parts)

    @staticmethod
    def _write(df: DataFrame, key: str, path: str, parts: int) -> None:
        numbered = df.withColumn(PART, F.pmod(F.hash(key), F.lit(parts)))
        numbered.repartition(parts, PART).write.partitionBy(PART).parquet(path)

    def _near(self, table: str, keys: DataFrame, key: str) -> DataFrame:
        """The rows of a table with one of the keys, from the files that can hold them. At most ``parts`` numbers are collected."""
        found = [r[0] for r in keys.select(F.pmod(F.hash(key), F.lit(self.parts))).distinct().collect()]
        return self.spark.read.parquet(f"{self.path}/{table}").where(F.col(PART).isin(found)).join(keys, key, "left_semi").drop(PART)

    def candidates(self, query: str) -> DataFrame:
        """Rows (id, name, kind, words) that the query can match; all rows for an empty query."""
        q = search.plain(query)
        if not q:
            return self.spark.read.parquet(f"{self.path}/rows").drop(PART)
        typos = 1 if len(q) <= search.SHORT_QUERY else 2
        lists = self.spark.read.schema("unit string, size int, letter string").parquet(f"{self.path}/lists")
        shared = lists.where(F.col("letter").isin(_letters(q))).groupBy("unit", "size").agg(F.count(F.lit(1)).alias("shared"))
        close = (F.abs(F.col("size") - len(q)) <= typos) & (F.col("shared") >= F.greatest(F.col("size"), F.lit(len(q))) - typos)
        units = shared.where((F.col("shared") == len(q)) | close).select("unit")
        # A word no longer than its typos need share nothing.
        if len(q) <= typos:
            whole = self.spark.read.parquet(f"{self.path}/members").where(F.length("unit") <= typos).select("unit")
            units = units.unionByName(whole).distinct()
        ids = self._near("members", units, "unit").select("id").distinct()
        return self._near("rows", ids, "id")

    def search(self, query: str) -> DataFrame:
        """``id`` and ``score`` of every row that matches, as ``functions.search.score`` has it."""
        held = self.candidates(query)
        scored = held.select("id", search.score(query, F.col("name"), F.col("kind"), F.col("words")).alias("score"))
        return scored.where(F.col("score").isNotNull())
