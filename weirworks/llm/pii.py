"""Personal data: four kinds found by their form, and more of the same kinds found by their context.

The finds by form are seeds. The words around them induce lexical patterns ("write to _"); patterns and the values that
they surround form a graph. In turns, a pattern is scored by the values it surrounds and a value by its patterns; found
values induce patterns of their own, until a round finds nothing new. So patterns that mostly surround a kind of data
point out values that the form alone doesn't show. Only DataFrame
functions are used; the texts are read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.llm.common import col, text_or_empty
from weirworks.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")

# The forms. Possessive loops and the looks behind give the same matches as the plain forms, but never try a run of
# characters again from its middle, so long runs stay linear and need no deep stack.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without these characters holds none of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

# A token with a digit or an at sign, and the bare numbers that follow it.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [0-9+().-]++)*+"
WINDOW, BLOCK = 60, 256


@dataclass(frozen=True)
class Bootstrap:
    """How patterns earn trust: the values a pattern needs that are seeds or were found before, and the least scores."""

    min_seeds: int = 3
    min_pattern: float = 0.5
    min_value: float = 0.5


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits ends in its check digit."""
    places = F.sequence(F.lit(1), F.length(number))

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(number, F.length(number) - place + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(place % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """What the form alone doesn't say."""
    count = F.length(digits(value))
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return count.between(12, 19) & F.when(count.between(12, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return count.between(9, 15)
    return F.lit(True)


def plausible(kind: Column, value: Column) -> Column:
    """Whether a value found by its context could be of the kind at all."""
    count = F.length(digits(value))
    return (
        F.when(kind == "email", value.contains("@"))
        .when(kind == "ip", value.rlike(r"^[0-9a-fA-F]{1,4}([.:-][0-9a-fA-F]{0,4}){3,7}$"))
        .when(kind == "card", count.between(12, 19) & value.rlike("^[0-9 -]+$"))
        .otherwise(count.between(7, 15) & value.rlike("^[0-9+() .-]+$"))
    )


def with_places(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """``p_<kind>``: the matches m_<kind> and gaps g_<kind> as structs of start, value, before and after.

    Starts are counted in code points. They are running sums, taken in blocks of 256 so that a text with very many
    matches costs little more than its length.
    """

    def steps(k: str) -> Column:
        return F.transform(f"m_{k}", lambda v, n: F.length(F.get(f"g_{k}", n)) + F.length(v))

    def before_block(k: str) -> Column:
        """The sum of all steps ahead of each block."""
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def add(state: Column, b: Column) -> Column:
            block = F.aggregate(F.slice(f"s_{k}", b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda t, x: t + x)
            return F.struct((state["at"] + block).alias("at"), F.array_append(state["out"], state["at"]).alias("out"))

        last = F.floor((F.size(f"s_{k}") - 1) / BLOCK).cast("int")
        return F.aggregate(F.sequence(F.lit(0), last), zero, add, lambda state: state["out"])

    def sums(k: str) -> Column:
        """The sum of the steps ahead of each match."""

        def inside(ahead: Column, b: Column) -> Column:
            start = F.struct(ahead.alias("at"), F.array().cast("array<int>").alias("out"))
            add = lambda state, x: F.struct((state["at"] + x).alias("at"), F.array_append(state["out"], state["at"]).alias("out"))
            return F.aggregate(F.slice(f"s_{k}", b * BLOCK + 1, F.lit(BLOCK)), start, add, lambda state: state["out"])

        return F.flatten(F.transform(f"b_{k}", inside))

    def places(k: str) -> Column:
        def place(value: Column, n: Column) -> Column:
            gap = F.get(f"g_{k}", n)
            return F.struct((F.get(f"a_{k}", n) + F.length(gap)).alias("start"), value.alias("value"), gap.alias("before"), F.get(f"g_{k}", n + 1).alias("after"))

        none = F.array().cast("array<struct<start:int,value:string,before:string,after:string>>")
        return F.when(F.size(f"a_{k}") > 0, F.transform(f"m_{k}", place)).otherwise(none)

    # Each step is asked for its size as well, which keeps the optimizer from moving it into the loop of the next.
    rows = rows.withColumns({f"s_{k}": F.when(F.size(f"m_{k}") > 0, steps(k)) for k in kinds})
    rows = rows.withColumns({f"b_{k}": F.when(F.size(f"s_{k}") > 0, before_block(k)) for k in kinds})
    rows = rows.withColumns({f"a_{k}": F.when(F.size(f"b_{k}") > 0, sums(k)) for k in kinds})
    return rows.withColumns({f"p_{k}": places(k) for k in kinds})


def _matches(text: Column, form: str, need: str | None) -> Column:
    every = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    return every if need is None else F.when(F.contains(text, F.lit(need)), every).otherwise(F.array().cast("array<string>"))


def by_form(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, base (array of start, kind, stop, value in order) and around (candidates with their contexts).

    ``row`` tells apart rows that share an id.
    """
    forms = FORMS | {"around": CANDIDATE}
    needs = NEEDS | {"around": None}
    rows = docs.select(F.monotonically_increasing_id().alias("row"), col(docs, doc_id).alias("doc_id"), text_or_empty(docs, text).alias("text"))
    rows = rows.withColumns({f"m_{k}": _matches(F.col("text"), form, needs[k]) for k, form in forms.items()})
    gaps = {f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", form, -1)) for k, form in forms.items()}
    rows = rows.withColumns(gaps).drop("text")
    rows = with_places(rows, list(forms))

    def spans(n: int, kind: str) -> Column:
        good = F.filter(f"p_{kind}", lambda p: holds(kind, p["value"]))
        end = lambda p: p["start"] + F.length(p["value"])
        return F.transform(good, lambda p: F.struct(p["start"].alias("start"), F.lit(n).alias("kind"), end(p).alias("stop"), p["value"].alias("value")))

    base = F.array_sort(F.concat(*[spans(n, k) for n, k in enumerate(KINDS)]))
    return rows.select("row", "doc_id", base.alias("base"), F.transform("p_around", _candidate).alias("around"))


def _words(text: Column) -> Column:
    """Letters of a context, in lower case, with one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def _candidate(found: Column) -> Column:
    """A candidate without the signs around it, and the patterns it stands in: two words before; one before, one after."""
    value = F.regexp_extract(found["value"], r"[0-9A-Za-z+].*[0-9A-Za-z]", 0)
    start = found["start"] + F.position(value, found["value"]) - 1
    before = _words(F.substring(found["before"], -WINDOW, WINDOW))
    after = F.substring_index(_words(F.substring(found["after"], 1, WINDOW)), " ", 1)
    left = F.regexp_extract(before, r"(\S+ \S+)$", 1)
    near = F.substring_index(before, " ", -1)
    return F.struct(start.alias("start"), value.alias("value"), left.alias("left"), near.alias("near"), after.alias("after"))


def _mentions(found: DataFrame) -> DataFrame:
    """Candidates with the kind of the seed that begins in them; those without one must touch no seed."""
    rows = found.select("row", "base", F.explode("around").alias("m")).select("row", "base", "m.*").where("value <> ''")
    stop = F.col("start") + F.length("value")
    touching = F.filter("base", lambda b: (b["start"] < stop) & (b["stop"] > F.col("start")))
    rows = rows.withColumns({"stop": stop, "seed": F.get(touching, 0)}).where("seed IS NULL OR seed.start >= start")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("seed.kind") + 1)
    return rows.select("row", "start", "stop", F.lower("value").alias("value"), F.when(F.col("seed").isNotNull(), kind).alias("kind"), "left", "near", "after")


def by_context(mentions: DataFrame, how: Bootstrap) -> DataFrame:
    """Values without the form of any kind that the patterns take for one: value, kind.

    Every round scores the patterns by all values known so far and the other values by the patterns. Scores only grow, so
    values are only added, and the rounds end with the first that adds none.
    """
    before = F.when(F.col("left") != "", F.concat(F.col("left"), F.lit(" _")))
    around = F.when((F.col("near") != "") & (F.col("after") != ""), F.concat_ws(" _ ", "near", "after"))
    links = mentions.select("value", "kind", F.explode(F.array_compact(F.array(before, around))).alias("pattern"))
    # One row per pattern and value, however often they meet: common patterns and values are summed before they move.
    pairs = cut_lineage(links.groupBy("pattern", "value").agg(F.max("kind").alias("kind")))
    sizes = pairs.groupBy("pattern").agg(F.count("*").alias("values"))
    seeds = pairs.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    open_ = pairs.where("kind IS NULL").select("pattern", "value")
    held = cut_lineage(seeds.join(sizes, "pattern").select("pattern", "kind", "seeds", F.lit(0).alias("gained"), F.lit(0.0).alias("found"), "values"))
    values, known = None, 0
    while True:
        # A pattern counts by the seeds and the values found so far that it surrounds; new ones qualify as values are found.
        trust = F.least((F.col("seeds") + F.col("found")) / F.col("values"), F.lit(0.99))
        enough = held.where(F.col("seeds") + F.col("gained") >= how.min_seeds).withColumn("trust", trust)
        votes = open_.join(enough.where(F.col("trust") >= how.min_pattern).select("pattern", "kind", "trust"), "pattern")
        scored = votes.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("score"))
        values = cut_lineage(scored.where((F.col("score") >= how.min_value) & plausible(F.col("kind"), F.col("value"))))
        now = values.count()
        if now == known:
            break
        known = now
        gained = open_.join(values, "value").groupBy("pattern", "kind").agg(F.count("*").alias("gained"), F.sum("score").alias("found"))
        both = seeds.join(gained, ["pattern", "kind"], "full").fillna(0, ["seeds", "gained"]).fillna(0.0, ["found"])
        held = cut_lineage(both.join(sizes, "pattern").select("pattern", "kind", "seeds", "gained", "found", "values"))
    # A value that fits several kinds is of the one with the best score, the first listed among equals.
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return values.groupBy("value").agg(F.min_by("kind", F.struct(-F.col("score"), rank)).alias("kind"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", how: Bootstrap | None = None) -> DataFrame:
    """One row per document: doc_id, base and spans (arrays of start, kind, stop), both in order of start and kind.

    ``base`` are the spans found by form, ``spans`` those and the ones found by context. Places are in code points, ends
    exclusive; kinds count from 0 in the order of ``KINDS``. A null text is an empty one and has no spans. Rows that
    share an id stay apart.
    """
    found = cut_lineage(by_form(docs, doc_id, text))
    mentions = cut_lineage(_mentions(found))
    values = by_context(mentions, how or Bootstrap())
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1
    more = mentions.where("kind IS NULL").drop("kind").join(values, "value")
    span = F.struct("start", number.cast("int").alias("kind"), "stop")
    more = more.groupBy("row").agg(F.collect_list(span).alias("more"))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["stop"].alias("stop")))
    joined = found.select("row", "doc_id", base.alias("base")).join(more, "row", "left")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return joined.select("doc_id", "base", every.alias("spans"))


def listed(spans: str) -> Column:
    """Spans as kind:start:stop, joined by commas."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    """How many of the spans are of a kind."""
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")
