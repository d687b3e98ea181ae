"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding undoes disguises: look-alike letters of other scripts, accents, digits and signs put in place of letters. The
lexicon is learned from labelled documents: words and beginnings of words that are much likelier in toxic ones, each
with its log odds as weight. Phrases in which such a word is harmless are exceptions. The weights of the matches,
alone and per 100 words, give the score through a logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weirworks.llm.common import col, text_or_empty
from weirworks.session import cut_lineage

# Letters of other scripts that look like Latin ones, and what digits and signs stand for.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѡ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "€": "e", "!": "i", "|": "i", "¡": "i", "+": "t"}

# A one may stand for an i or an l, so both fold to the same letter.
TABLE = str.maketrans(LOOKALIKES | DIGITS | {"l": "i"})
SIGN = re.compile(r"(?<=\w)[!|¡+](?=\w)|[@$€](?=\w)")
OTHER = re.compile(r"[\W_]+")
HIDDEN = re.compile("[­​-‍⁠﻿]")
PREFIXES = range(3, 10)


def fold(text: str) -> str:
    """Words in folded letters, with one space before, between and after them."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", HIDDEN.sub("", text))
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    text = SIGN.sub(lambda m: SIGNS[m.group()], text).translate(TABLE)
    return f" {OTHER.sub(' ', text).strip()} "


@dataclass(frozen=True)
class Model:
    """The lexicon, exceptions and curve.

    A key of the lexicon begins with a space. If it ends with one too, it is a word; else it is the beginning of a longer
    word.
    """

    lexicon: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-4.0, 1.0, 0.5)
    _made: list = field(default_factory=list, compare=False, repr=False)

    def __getstate__(self):
        return {"lexicon": self.lexicon, "exceptions": self.exceptions, "curve": self.curve, "_made": []}

    def _automaton(self):
        if not self._made:
            made = ahocorasick.Automaton()
            for key, weight in self.lexicon.items():
                made.add_word(key, (len(key), weight))
            for phrase in self.exceptions:
                made.add_word(f" {phrase} ", (len(phrase) + 2, None))
            made.make_automaton()
            self._made.append(made)
        return self._made[0]

    def matches(self, folded: str) -> dict[int, float]:
        """Start of each matched word, with the largest weight found there; words inside exceptions don't count."""
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        if self.lexicon:
            for end, (length, weight) in self._automaton().iter(folded):
                start = end - length + 1
                if weight is None:
                    excused.append((start, end))
                elif weight > found.get(start, 0.0) and (folded[end] == " " or folded[end + 1] != " "):
                    found[start] = weight
        return {s: w for s, w in found.items() if not any(a <= s < b for a, b in excused)} if excused else found

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        # A word counts once, however often a text repeats it: rows of the same word are junk rather than insults.
        weight = sum({folded[s + 1 : folded.index(" ", s + 1)]: w for s, w in self.matches(folded).items()}.values())
        words = max(1, folded.count(" ") - 1)
        return math.log1p(weight), math.log1p(100.0 * weight / words)

    def score(self, text: str) -> float:
        x, y = self.features(text)
        a, b, c = self.curve
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _family(folded: str) -> int:
    """Smallest hash of three words in a row, which copies of a text mostly share."""
    words = folded.split()
    return min(xxhash.xxh64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))) >> 1


def _keys(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) >= 3} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


def learn(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = 20_000,
    min_docs: int = 6,
    min_odds: float = 2.0,
    exceptions: Sequence[str] = (),
) -> Model:
    """A model from labelled documents: at most ``sample_rows`` of them, those whose ids hash lowest.

    Labels that are null, and ids without a text, take no part; copies of a text count about once. With no toxic or no
    clean document the lexicon is empty and every score is the share of toxic labels. ``sample_rows`` bounds what goes to the
    driver and to the tasks: every term and phrase above the thresholds, all found in those documents.
    """
    known = labels.where(col(labels, label).isin(0, 1)).select(col(labels, doc_id).alias("doc_id"), col(labels, label).cast("int").alias("toxic"))
    sample = known.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(col(docs, doc_id).alias("doc_id"), text_or_empty(docs, text).alias("text")).join(F.broadcast(sample), "doc_id")

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["folded"] = batch["text"].map(fold)
            batch["family"] = batch["folded"].map(_family)
            yield batch

    train = rows.mapInPandas(folded, "doc_id long, text string, toxic int, folded string, family long")
    one = train.groupBy("family", "toxic").agg(F.min(F.struct("doc_id", "text", "folded")).alias("row"))
    train = cut_lineage(one.select("toxic", "row.doc_id", "row.text", "row.folded"))
    sizes = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model({}, curve=(math.log((toxic + 0.5) / (clean + 0.5)), 0.0, 0.0))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            in_toxic: Counter[str] = Counter()
            in_clean: Counter[str] = Counter()
            for body, mark in zip(batch["folded"], batch["toxic"], strict=True):
                (in_toxic if mark else in_clean).update(_keys(body))
            keys = list(in_toxic | in_clean)
            yield pd.DataFrame({"term": keys, "toxic": [in_toxic[k] for k in keys], "clean": [in_clean[k] for k in keys]})

    terms = train.mapInPandas(counted, "term string, toxic long, clean long")
    terms = terms.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    least = min(min_docs, max(1, toxic // 4))
    good = terms.withColumn("odds", odds).where((F.col("toxic") >= least) & (F.col("odds") >= min_odds))
    found = {r.term: r.odds for r in good.select("term", "odds").collect()}
    lexicon = {}
    for term in sorted(found, key=len):
        # A longer term says no more than a beginning of it that is as good a sign.
        shorter = [lexicon[term[:n]] for n in range(PREFIXES.start + 1, len(term.rstrip())) if term[:n] in lexicon]
        if not any(w >= 0.8 * found[term] for w in shorter):
            lexicon[term] = found[term]

    raw = Model(lexicon, tuple(f.strip() for f in map(fold, exceptions)))

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for body, mark in zip(batch["folded"], batch["toxic"], strict=True):
                seen = set()
                for start in raw.matches(body):
                    before, after = body[:start].rpartition(" ")[2], body[start + 1 :].split(" ", 2)
                    seen |= {f"{before} {after[0]}"} if before else set()
                    seen |= {f"{after[0]} {after[1]}"} if len(after) > 1 and after[1] else set()
                out += [(p, mark) for p in seen]
            yield pd.DataFrame(out, columns=["phrase", "toxic"])

    counts = train.mapInPandas(phrases, "phrase string, toxic int").groupBy("phrase")
    counts = counts.agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    harmless = counts.where((F.col("clean") >= 3) & (F.col("clean") * F.lit(toxic) > 3 * F.col("toxic") * F.lit(clean)))
    learned = sorted(r.phrase for r in harmless.select("phrase").collect())
    raw = Model(lexicon, (*raw.exceptions, *learned))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([raw.features(t) for t in batch["text"]], columns=["x", "y"])
            yield out.assign(toxic=batch["toxic"].to_numpy())

    # At most sample_rows rows of three numbers.
    points = train.mapInPandas(measured, "x double, y double, toxic int").toPandas().sort_values(["x", "y", "toxic"])
    return Model(lexicon, raw.exceptions, _logistic(points[["x", "y"]].to_numpy(), points["toxic"].to_numpy()))


def _logistic(points: np.ndarray, marks: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; the ridge keeps it finite where the classes part without error."""
    x = np.column_stack([np.ones(len(points)), points])
    w = np.zeros(3)
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (marks - p) - ridge * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def with_scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row; null and empty texts get the score of a text without matches."""
    rows = docs.select(col(docs, doc_id).alias("doc_id"), text_or_empty(docs, text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], StructField("score", DoubleType())]))


def clean_documents(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` (all columns, rows as they are) without those that score ``threshold`` or more; null counts as empty."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [model.score(t or "") < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
