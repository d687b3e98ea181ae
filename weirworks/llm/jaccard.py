"""Near copies: the join of all texts whose sets of word runs have a Jaccard similarity of at least a threshold.

Texts with equal sets are one class from the start. Classes that agree in a band of MinHash values are candidates. A
pair's values are then compared a few at a time; after each step the pair is dropped if, given the matches so far, the
probability that its similarity reaches the threshold is below a tolerance (a uniform prior makes this a binomial tail).
What is left is verified on the sets themselves.

Large groups of candidates are cut into blocks, and pairs of blocks are compared inside a task. No row is ever made per
pair: a task returns, per class, the number of its links and a root of the tree that they form.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirworks.llm.common import col, fresh
from weirworks.llm.cuckoo import mix
from weirworks.llm.hashing import shingle_sets
from weirworks.session import cut_lineage

HASHES, ROWS = 64, 3
BANDS = 16  # of 3 values each: a pair at 0.8 is missed by all bands in 1 of 100,000 cases
STEP = 16
BLOCK = 512
BATCH, PAIRS = 2_000, 200_000  # rows that a call takes on, and pairs compared at once
SETS = "row long, named boolean, doc_id long, text_id long, size int, set_a long, set_b long, signature binary, bands array<long>"
UNIT = ["band", "key", "left", "right"]
ID = ["named", "doc_id", "text_id"]


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    numbers = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    return numbers[:HASHES] | np.uint64(1), numbers[HASHES:]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a non-empty set."""
    factor, shift = _seeds()
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        values = ((part[None, :] * factor[:, None] + shift[:, None]) >> np.uint64(32)).astype(np.uint32)
        out = np.minimum(out, values.min(axis=1))
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    parts = values[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.zeros(BANDS, np.uint64)
    for n in range(ROWS):
        key = mix(key ^ parts[:, n])
    return key.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n values, the matches below which P(similarity >= threshold) is under the tolerance."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def _sums(hashes: np.ndarray) -> tuple[int, int]:
    """Two sums that, with its size, stand for a set."""
    a, b = hashes.sum(dtype=np.uint64), mix(hashes ^ np.uint64(0x5555)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for hashes in shingle_sets(batch["text"].tolist()):
            if not len(hashes):
                rows.append((0, 0, 0, None, None))
                continue
            values = signature(hashes)
            rows.append((len(hashes), *_sums(hashes), values.tobytes(), band_keys(values)))
        found = pd.DataFrame(rows, columns=["size", "set_a", "set_b", "signature", "bands"])
        # Masked only here: with None among them the sums would have been floats and lost their last digits.
        for c in ("set_a", "set_b"):
            found[c] = found[c].astype("Int64").mask(found["size"] == 0)
        yield pd.concat([batch[["row", "named", "doc_id", "text_id"]].reset_index(drop=True), found], axis=1)


def _units(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows sorted by unit and class, and where each unit begins (with the end)."""
    rows = rows.sort_values([*UNIT, "rep"], kind="stable").reset_index(drop=True)
    new = (rows[UNIT] != rows[UNIT].shift()).any(axis=1).to_numpy()
    return rows, np.r_[np.flatnonzero(new), len(rows)]


def _pairs(block: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Every pair inside a block, or between two blocks, as places in the unit."""
    if left == right:
        return np.triu_indices(len(block), 1)
    a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _pruned(threshold: float, least: dict[int, int]):
    """Candidates of some pairs of blocks: per unit and class its partners that the comparison did not drop."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, cuts = _units(rows)
        values = np.stack([np.frombuffer(s, np.uint32) for s in rows["signature"]])
        keys, size, band = np.stack(rows["bands"]), rows["size"].to_numpy(), rows["band"].to_numpy()
        block, left, right = rows["block"].to_numpy(), rows["left"].to_numpy(), rows["right"].to_numpy()
        places = np.arange(BANDS)

        def kept(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
            i, j = i[ok], j[ok]
            # A pair that meets in an earlier band is compared there.
            ok = ~((keys[i] == keys[j]) & (places < band[i][:, None])).any(axis=1)
            i, j = i[ok], j[ok]
            matches = np.zeros(len(i), np.int64)
            for n in range(STEP, HASHES + 1, STEP):
                matches += (values[i, n - STEP : n] == values[j, n - STEP : n]).sum(axis=1)
                good = matches >= least[n]
                i, j, matches = i[good], j[good], matches[good]
            return np.stack([i, j])

        found, held, count = [], [], 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            i, j = _pairs(block[a:b], left[a], right[a])
            held.append((i + a, j + a))
            count += len(i)
            if count >= PAIRS or b == len(rows):
                i, j = (np.concatenate(x) for x in zip(*held, strict=True))
                found += [kept(i[n : n + PAIRS], j[n : n + PAIRS]) for n in range(0, len(i), PAIRS)]
                held, count = [], 0
        i, j = np.concatenate(found, axis=1)
        order = np.argsort(i, kind="stable")
        i, j, rep = i[order], j[order], rows["rep"].to_numpy()
        involved = np.unique(np.r_[i, j])
        partners = np.split(rep[j], np.searchsorted(i, involved)[1:])
        return rows.loc[involved, [*UNIT, "batch", "rep"]].assign(partners=partners)

    return run


def _verified(threshold: float):
    """Exact similarities of the candidates of one pair of blocks: per class, documents linked and a root."""

    def unit(rows: pd.DataFrame) -> pd.DataFrame:
        rep, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        place = {r: n for n, r in enumerate(rep.tolist())}
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        size = np.array([len(s) for s in sets])
        terms, every = np.unique(np.concatenate(sets), return_inverse=True)
        tokens = np.split(every, np.cumsum(size)[:-1])
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        mark = np.zeros(len(terms), np.int32)

        def top(n: int) -> int:
            while root[n] != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        for i, partners in enumerate(rows["partners"]):
            if not len(partners):
                continue
            j = np.array([place[p] for p in partners.tolist()])
            mark[tokens[i]] = 1
            both = np.add.reduceat(mark[np.concatenate([tokens[x] for x in j])], np.r_[0, np.cumsum(size[j])[:-1]])
            mark[tokens[i]] = 0
            j = j[both / (size[i] + size[j] - both) >= threshold]
            links[i] += copies[j].sum()
            np.add.at(links, j, copies[i])
            for x in j.tolist():
                a, b = top(i), top(x)
                root[max(a, b)] = min(a, b)
        roots = np.array([rep[top(n)] for n in range(len(rep))])
        return pd.DataFrame({"rep": rep, "root": roots, "links": links})[links > 0]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, cuts = _units(rows)
        return pd.concat([unit(rows.iloc[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    return run


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node and label, the smallest node that it is connected with; for nodes that have an edge.

    Each round takes the smallest label among the neighbours and then the label's own label, so a chain halves with
    every round. Rounds are written out.
    """
    edges = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = moved.join(jump, F.col("next") == F.col("at"), "left").select("node", F.col("label").alias("old"), F.least("next", F.coalesce("further", "next")).alias("label"))
        new = cut_lineage(new)
        labels = new.drop("old")
        if new.where("old <> label").isEmpty():
            return labels


def _linked(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs`` (row, doc_id, text): row, doc_id, class_id, n_links and first, whether it stands for its class."""
    # A null in a column of numbers would make all of them floats in Python.
    named = F.col("doc_id").isNotNull()
    own = docs.select("row", named.alias("named"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    # Written once, so the numbers of the rows stay; ids may repeat.
    sets = cut_lineage(own.mapInPandas(_sets, SETS))
    same = ["set_a", "set_b", "size"]
    reps = sets.where("size > 0").groupBy(*same).agg(
        F.min("row").alias("rep"), F.min_by(F.struct(*ID), "row").alias("of_rep"), F.count("*").alias("copies"),
        F.min(F.struct((~F.col("named")).alias("unnamed"), "doc_id", "text_id", "row")).alias("low"),
        F.first("signature").alias("signature"), F.first("bands").alias("bands"),
    )
    reps = cut_lineage(reps)

    placed = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = cut_lineage(placed.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1"))
    members = placed.join(buckets, ["band", "key"])
    cuts = F.ceil(F.col("members") / F.lit(block)).cast("int")
    members = members.select("rep", "band", "key", cuts.alias("cuts"), F.pmod(F.xxhash64("rep"), cuts).cast("int").alias("block"))
    # A block meets itself and every other block of its bucket.
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")
    units = members.select("rep", "band", "key", "block", other)
    units = units.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")}).drop("other")
    # Most units have two rows, so a call takes many units.
    rows = buckets.agg(F.sum(F.col("members") * F.ceil(F.col("members") / F.lit(block)))).first()[0] or 0
    units = units.withColumn("batch", F.pmod(F.xxhash64(*UNIT), F.lit(max(1, -(-int(rows) // BATCH)))))
    full = units.join(reps.select("rep", "size", "signature", "bands"), "rep")
    least = least_matches(threshold, tolerance)
    kept = full.groupBy("batch").applyInPandas(_pruned(threshold, least), "band int, key long, left int, right int, batch long, rep long, partners array<long>")
    kept = cut_lineage(kept)

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(shingle_sets(batch["text"].drop_duplicates().tolist()))
            sums = [_sums(h) for h in found]
            yield pd.DataFrame({
                "set_a": [s[0] for s in sums], "set_b": [s[1] for s in sums], "size": [len(h) for h in found],
                "shingles": [h.tobytes() for h in found],
            })

    asked = kept.select("rep").distinct().join(reps.select("rep", "of_rep", "copies", *same), "rep")
    texts = own.select(*ID, "text").join(asked.select("of_rep.*"), ID, "left_semi")
    shingles = texts.mapInPandas(shingled, "set_a long, set_b long, size int, shingles binary")
    shingles = shingles.join(asked.drop("of_rep"), same).groupBy("rep").agg(F.first("copies").alias("copies"), F.first("shingles").alias("shingles"))
    checked = kept.join(cut_lineage(shingles), "rep").groupBy("batch").applyInPandas(_verified(threshold), "rep long, root long, links long")
    checked = cut_lineage(checked)

    labels = components(checked, "rep", "root")
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select(*same, "rep", "low", "copies").join(links, "rep", "left")
    known = known.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    known = known.withColumn("label", F.coalesce("label", "rep"))
    lowest = known.groupBy("label").agg(F.min("low").alias("class"))
    known = known.join(lowest, "label").select(*same, "class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = sets.select("row", *ID, *same).join(known, same, "left")
    own_id, class_id = F.when(F.col("named"), F.col("doc_id")), F.when(~F.col("class.unnamed"), F.col("class.doc_id"))
    worded = F.col("size") > 0
    return out.select(
        "row", own_id.alias("doc_id"), F.when(worded, class_id).otherwise(own_id).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), (~worded | (F.col("row") == F.col("class.row"))).alias("first"),
    )


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every_row: bool = False, **options) -> DataFrame:
    """One row per document: doc_id, class_id and n_links.

    ``n_links`` counts the other documents with a similarity of at least ``threshold`` (0.8) over runs of five words;
    ``class_id`` is the smallest id among all documents reached over links. Words are runs of letters and digits in
    lower case; a text with fewer than five has one run. Null texts and texts without words are like no other. Rows
    that share an id are documents with the same id. Rows without an id are left out, or with ``every_row`` are
    documents too; a class of such rows only has no ``class_id``. Of pairs at exactly 0.8, about 1 in 100,000 shares no
    band and stays unseen; more similar pairs are missed far more rarely still.
    """
    own = docs.select(col(docs, doc_id).cast("long").alias("doc_id"), col(docs, text).cast("string").alias("text"))
    own = own if every_row else own.where("doc_id IS NOT NULL")
    return _linked(own.withColumn("row", F.monotonically_increasing_id()), **options).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` (all columns) with one id of each class of near copies, the smallest, and all rows of that id.

    Rows without an id go. ``one_row_of_each`` judges every row by itself.
    """
    kept = near_copies(docs, doc_id, text, **options).where("doc_id = class_id").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(kept, doc_id, "left_semi").select(*[col(docs, c) for c in docs.columns])


def one_row_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` (all columns) with one row of each class of near copies: the one with the smallest id.

    Ids may repeat or be null; a row without an id stays if no row of its class has one and it comes first. Rows without
    words all stay.
    """
    (number,) = fresh(docs, "near_row")
    # Written once, so that a row has the same number wherever it is read.
    docs = cut_lineage(docs.withColumn(number, F.monotonically_increasing_id()))
    own = docs.select(F.col(number).alias("row"), col(docs, doc_id).cast("long").alias("doc_id"), col(docs, text).cast("string").alias("text"))
    kept = _linked(own, **options).where("first").select(F.col("row").alias(number))
    return docs.join(kept, number, "left_semi").select(*[col(docs, c) for c in docs.columns if c != number])
