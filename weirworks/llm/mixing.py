"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key, scaled by a weight of its quality (Efraimidis and Spirakis): sorting by the
key is a weighted draw without replacement. A source whose target is k times its size and a rest is taken k times as a
whole; the rest goes to the documents with the smallest keys, up to the budget. Only DataFrame functions are used.

No task sees a whole source. Keys are counted in 1,024 ranges per source, the range in which the budget ends in
1,024 finer ones, and only documents of that one fine range are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirworks.llm.common import BLANKS, col, fresh, text_or_empty
from weirworks.session import cut_lineage

RANGES = 1024


def word_count(text: Column) -> Column:
    """Runs of characters other than the ASCII blanks."""
    spaced = F.btrim(F.translate(text, BLANKS, " " * len(BLANKS)))
    return F.when(spaced == "", 0).otherwise(F.size(F.split(spaced, " +", -1))).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.25 to 1: the share of characters that do not belong to mark-up, shouting or numbers.

    A text without characters weighs 0.25. Any positive weight keeps the draw right; this one prefers prose.
    """
    chars = F.length(text)
    odd = chars - F.length(F.translate(text, "#$%&*!<>{}[]|\\~^_=+@0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return F.when(chars == 0, F.lit(0.25)).otherwise(1.0 - F.lit(0.75) * odd / chars)


def source_targets(sizes: DataFrame, weights: Sequence[float], total_share: float, most: float) -> DataFrame:
    """Per source (columns source, source_size) its target.

    Sources in code-point order, null last, take ``weights`` in turn and share ``total_share`` of all sizes. No
    target goes over ``most`` times its source's size; what is over is shared out again by weight. In the end a source
    holds the lesser of its limit and weight x level. The level follows from running sums over the sources in the order
    in which they reach their limits: one row per source, so the table is small whatever the documents are.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    # A source is full at the level most / weight. Take the sources in that order: the first ones are full, and the level
    # is what is left over the weights of the others; it is right as soon as the next source is not full at it.
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(total_share))
    level = (wanted - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    tried = ranked.withColumn("level", level).withColumn("full_at", F.col("most") / F.col("weight"))
    found = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(Window.partitionBy())
    target = F.when(found.isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * found["level"]))
    return tried.select("source", "source_size", target.alias("target"))


def draw_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """An exponential number with rate ``weight``, from a hash of the id: the same in every run."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10)
    return -F.ln((bits.cast("double") + 0.5) / F.lit(float(2**48))) / weight


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    total_share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    row: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs (how often it is taken), taken.

    Null texts have size 0 and are taken like any other document (with no words). Null sources are one source. Ties of
    the key, as rows that share an id have, go by id and then by size; rows equal in these are alike, so any of them may
    be the one at the border. The last document taken in part of a source is the one that brings the sum nearest to
    the target. Rows come back for every document, also where it is not taken.

    ``row`` names a column with a number of each row. It comes back as ``row`` and decides ties, and rows without an id
    then draw by their text instead of all alike.
    """
    body = text_or_empty(docs, text)
    number, carried = ([], []) if row is None else ([col(docs, row).alias("row")], ["row"])
    drawn_by = col(docs, doc_id) if row is None else F.coalesce(col(docs, doc_id).cast("string"), body)
    drawn = docs.select(
        *number,
        col(docs, doc_id).alias("doc_id"),
        col(docs, source).cast("string").alias("source"),
        word_count(body).alias("size"),
        draw_key(drawn_by, quality_weight(body), seed).alias("draw"),
    )
    # 1 - exp(-key / 4) spreads the keys over 0 to 1 and keeps their order.
    place = 1 - F.exp(-F.col("draw") / 4)
    coarse = F.least(F.lit(RANGES - 1), F.floor(place * RANGES)).cast("int")
    fine = F.least(F.lit(RANGES - 1), F.floor((place * RANGES - coarse) * RANGES)).cast("int")
    drawn = cut_lineage(drawn.withColumns({"coarse": coarse, "fine": fine}))

    sums = cut_lineage(drawn.groupBy("source", "coarse").agg(F.sum("size").alias("words")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total_share, most)
    size = F.col("source_size")
    epochs = F.when(size == 0, F.lit(1)).otherwise(F.floor(F.col("target") / size))
    targets = targets.withColumn("whole", F.least(epochs, F.lit(int(most))).cast("int"))
    targets = cut_lineage(targets.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * size)))

    def border(counted: DataFrame, kind: str, start: Column) -> DataFrame:
        """The first range of each source whose running sum passes the budget, and the words before it."""
        order = Window.partitionBy("source").orderBy(kind)
        running = counted.withColumn("upto", start + F.sum("words").over(order))
        over = running.where(F.col("upto") > F.col("budget"))
        first = over.groupBy("source").agg(F.min(F.struct(F.col(kind), (F.col("upto") - F.col("words")).alias("before"))).alias("first"))
        return first.select(F.col("source").alias("border_source"), F.col(f"first.{kind}").alias(f"end_{kind}"), F.col("first.before").alias(f"before_{kind}"))

    def with_border(df: DataFrame, edges: DataFrame) -> DataFrame:
        return df.join(edges, F.col("source").eqNullSafe(F.col("border_source")), "left").drop("border_source")

    known = targets.withColumnRenamed("source", "target_source")
    first = border(sums.join(known, F.col("source").eqNullSafe(F.col("target_source"))), "coarse", F.lit(0.0))
    targets = with_border(targets, first)
    known = targets.withColumnRenamed("source", "target_source")
    near = drawn.join(known, F.col("source").eqNullSafe(F.col("target_source"))).where("coarse = end_coarse")
    parts = near.groupBy("source", "fine", "budget", "before_coarse").agg(F.sum("size").alias("words"))
    targets = cut_lineage(with_border(targets, border(parts, "fine", F.col("before_coarse"))))

    known = targets.withColumnRenamed("source", "target_source")
    rows = drawn.join(known, F.col("source").eqNullSafe(F.col("target_source")), "left")
    at_border = F.coalesce((F.col("coarse") == F.col("end_coarse")) & (F.col("fine") == F.col("end_fine")), F.lit(False))
    below = F.col("end_coarse").isNull() | (F.col("coarse") < F.col("end_coarse")) | ((F.col("coarse") == F.col("end_coarse")) & (F.col("fine") < F.col("end_fine")))
    rows = rows.withColumn("at_border", at_border).withColumn("extra", (F.col("budget") > 0) & below)
    # The documents of one fine range are all that is ever sorted; they are apart from the rest.
    order = Window.partitionBy("source").orderBy("draw", "doc_id", "size", *carried)
    middle = F.col("before_fine") + F.sum("size").over(order) - F.col("size") / 2
    edge = rows.where("at_border").withColumn("extra", (F.col("budget") > 0) & (middle <= F.col("budget")))
    rows = rows.where("NOT at_border").unionByName(edge)
    times = F.when(F.col("whole") >= int(most), F.lit(int(most))).otherwise(F.col("whole") + F.col("extra").cast("int"))
    return rows.select(*carried, "doc_id", "source", "size", "source_size", "target", times.alias("epochs"), (times * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` as the mix takes them: rows that are taken twice come twice, rows that are not taken go.

    Rows are matched by a number of their own, so ids may repeat or be null.
    """
    number, times, copy = fresh(docs, "mix_row", "mix_times", "mix_copy")
    # Written once, so that a row has the same number wherever it is read.
    numbered = cut_lineage(docs.withColumn(number, F.monotonically_increasing_id()))
    taken = mix(numbered, doc_id, row=number, **options).where("epochs > 0").select(F.col("row").alias(number), F.col("epochs").alias(times))
    repeated = numbered.join(taken, number).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.select(*[col(repeated, c) for c in docs.columns])
