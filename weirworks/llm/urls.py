"""Verdicts on URLs: rules first, for all others the ratio of two character language models.

The rules label part of the URLs. Two variable-order Markov models, of accepted and of rejected URLs, count every
character behind up to ``ORDER`` characters; a longer context is smoothed by the next shorter one in proportion to the
number of different characters seen in it, down to a uniform chance. A URL's score is the difference of its two
log-likelihoods divided by its length, and the least score that is let through is calibrated on a quarter of the labelled
URLs that the models have not seen. Everything is counted from all labelled URLs, distinct ones once; only DataFrame functions
are used.

Grams of ``ORDER + 1`` characters carry all that a position needs. Each distinct gram is judged once: its shorter endings are
joined from the shortest on, so no key has more rows than there are characters. URLs meet the grams' scores in two ways
with the same result: those of the most frequent grams (at most ``HOT``) are sent to every task and summed before any row
is moved; all others meet theirs by a join on the gram.

A null URL, and one without ``://``, has an empty host and path and is judged as the empty text. Repeated rows have equal
verdicts; ids may be null or repeated. Without accepted or rejected URLs a model is uniform, and without held-out URLs of
both kinds the least score is 0, which an empty table never uses. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirworks.llm.common import col
from weirworks.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORDER = 5
# The chance of a character without any context, 1 / SYMBOLS; scores are whole millionths, thresholds whole thousandths.
SYMBOLS, MICRO, MILLI, WIDEST = 256.0, 1_000_000, 1_000, 20_000
# A gram in more than one of HOT positions is frequent; so there are fewer than HOT of those.
HOT = 10_000
BEGIN, END = "\x02", "\x03"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def shown(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest(rules: Sequence[Rule], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, null if none does; of equally long ones the earlier."""
    found = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(value(r)))
        for r in sorted(rules, key=lambda r: -len(r.shown))
    ]
    return F.coalesce(*found, F.lit(None).cast("string"))


def grams(text: Column) -> Column:
    """For every character of a text, and for its end, the ORDER characters before it and itself."""
    symbols = F.regexp_extract_all(F.concat(F.lit(BEGIN * ORDER), text, F.lit(END)), F.lit("(?s)."), F.lit(0))
    return F.transform(
        F.sequence(F.lit(ORDER), F.size(symbols) - 1),
        lambda at: F.concat(*[F.get(symbols, at - n) for n in reversed(range(ORDER + 1))]),
    )


def _endings(table: DataFrame) -> DataFrame:
    """Rows of a table of grams, once for each ending of their grams."""
    sizes = F.array(*[F.lit(n) for n in range(1, ORDER + 2)])
    return table.withColumn("gram", F.explode(F.transform(sizes, lambda n: F.right("gram", n))))


def _before(gram: str) -> Column:
    return F.expr(f"left({gram}, length({gram}) - 1)")


def learned(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts per gram of any length up to ORDER + 1 and per context, from distinct ``text`` with ``accepted`` (boolean)."""
    whole = texts.select(F.explode(grams(F.col("text"))).alias("gram"), "accepted")
    whole = whole.groupBy("gram").agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no"))
    counts = cut_lineage(_endings(whole).groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
    contexts = counts.groupBy(_before("gram").alias("context")).agg(
        F.sum("yes").alias("all_yes"),
        F.count_if(F.col("yes") > 0).alias("kinds_yes"),
        F.sum("no").alias("all_no"),
        F.count_if(F.col("no") > 0).alias("kinds_no"),
    )
    return counts, contexts


def _chance(seen: str, below: Column) -> Column:
    kinds, whole = F.col(f"kinds_{seen}"), F.col(f"all_{seen}")
    mixed = (F.coalesce(F.col(seen), F.lit(0)) + kinds * below) / (whole + kinds)
    return F.when(F.coalesce(whole, F.lit(0)) > 0, mixed).otherwise(below)


def gram_scores(needed: DataFrame, counts: DataFrame, contexts: DataFrame) -> DataFrame:
    """``gram``, ``uses`` and ``score`` (millionths of a nat) of the grams in ``needed`` (gram, uses; distinct)."""
    endings = _endings(needed.select("gram")).distinct().withColumn("context", _before("gram"))
    known = endings.join(counts, "gram", "left").join(contexts, "context", "left").drop("context")
    known = cut_lineage(known.withColumn("long", F.length("gram")))
    start = F.lit(1.0 / SYMBOLS)
    level = known.where("long = 1").select("gram", _chance("yes", start).alias("p"), _chance("no", start).alias("q"))
    for n in range(2, ORDER + 2):
        below = level.select(F.col("gram").alias("rest"), F.col("p").alias("p0"), F.col("q").alias("q0"))
        level = known.where(F.col("long") == n).withColumn("rest", F.right("gram", F.lit(n - 1))).join(below, "rest")
        level = level.select("gram", _chance("yes", F.col("p0")).alias("p"), _chance("no", F.col("q0")).alias("q"))
    score = F.floor((F.ln("p") - F.ln("q")) * MICRO + 0.5)
    return cut_lineage(level.join(needed, "gram").select("gram", "uses", score.alias("score")))


def text_scores(texts: DataFrame, counts: DataFrame, contexts: DataFrame) -> DataFrame:
    """``id`` and ``score`` in thousandths of a nat per character, rounded down, of texts (unique ``id``, ``text``)."""
    spots = texts.select("id", F.explode(grams(F.col("text"))).alias("gram"))
    needed = cut_lineage(spots.groupBy("gram").agg(F.count(F.lit(1)).alias("uses")))
    scores = gram_scores(needed, counts, contexts)
    total = needed.agg(F.sum("uses")).first()[0] or 0
    # Fewer than HOT grams of ORDER + 1 characters.
    hot = F.broadcast(scores.where(F.col("uses") > total / HOT))
    near = spots.join(hot, "gram").groupBy("id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
    rare = spots.join(hot.select("gram"), "gram", "left_anti").join(scores.select("gram", "score"), "gram")
    far = rare.groupBy("id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"))
    both = near.unionByName(far).groupBy("id").agg(F.sum("score").alias("score"), F.sum("n").alias("n"))
    return both.select("id", F.floor(F.col("score") / (F.col("n") * MICRO / MILLI)).alias("score"))


def least_score(scored: DataFrame) -> DataFrame:
    """One row: the ``least`` score to accept, by which the held-out ``score`` and ``accepted`` part best.

    Best is the largest sum of both shares judged rightly, of equally good ones the nearest to 0, then the smaller.
    Scores beyond WIDEST count as WIDEST, so the table of counts is bounded.
    """
    bin_ = F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.col("score"))).cast("long")
    bins = scored.groupBy(bin_.alias("bin")).agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no"))
    every, below = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)

    def total(name: str, over) -> Column:
        return F.coalesce(F.sum(name).over(over), F.lit(0)).cast("decimal(19,0)")

    yes, no = total("yes", every), total("no", every)
    right = (yes - total("yes", below)) * no + total("no", below) * yes
    best = F.max_by("bin", F.struct("right", (-F.abs("bin")).alias("near"), (-F.col("bin")).alias("small")))
    judged = bins.select("bin", right.alias("right"), yes.alias("all_yes"), no.alias("all_no"))
    usable = (F.max("all_yes") > 0) & (F.max("all_no") > 0)
    return judged.agg(F.coalesce(F.when(usable, best), F.lit(0).cast("long")).alias("least"))


def judge(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row. ``rules`` say ``allow`` or ``block``; the list is part of the plan."""
    parts = pages.select(col(pages, page_id).alias(page_id), host_of(col(pages, url)).alias("host"), path_of(col(pages, url)).alias("path"))
    host, path = F.col("host"), F.col("path")
    told = parts.withColumn("rule", longest(rules, host, path, lambda r: r.shown)).withColumn("said", longest(rules, host, path, lambda r: r.verdict))
    told = told.withColumn("text", F.concat("host", "path")).withColumn("held_out", F.substring(F.md5("text"), 1, 1) < "4")
    rows = cut_lineage(told.withColumn("id", F.monotonically_increasing_id()))
    accepted = (F.col("said") == "allow").alias("accepted")
    ruled, open_ = rows.where("said IS NOT NULL"), rows.where("said IS NULL")
    counts, contexts = learned(ruled.where("NOT held_out").select("text", accepted).distinct())
    scored = cut_lineage(text_scores(reduce(DataFrame.unionByName, [open_, ruled.where("held_out")]).select("id", "text"), counts, contexts))
    # The least score is a single row.
    least = F.broadcast(least_score(ruled.where("held_out").select("id", accepted).join(scored, "id")))
    by_model = scored.crossJoin(least).select("id", F.when(F.col("score") >= F.col("least"), "allow").otherwise("block").alias("found"))
    out = rows.join(by_model, "id", "left")
    return out.select(page_id, "host", "path", "rule", F.coalesce("said", "found").alias("verdict"))
