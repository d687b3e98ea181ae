"""Joins, lookups and upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirworks.operators.ordered import PIECE, in_pieces, top_per_key
from weirworks.session import cut_lineage

# Join types a join step may name, and Spark's name for each.
JOIN_TYPES = {
    "equijoin": "inner",
    "inner": "inner",
    "left": "left",
    "right": "right",
    "outer": "full",
    "leftsemi": "leftsemi",
    "leftanti": "leftanti",
}


def suffix_duplicates(left: DataFrame, right: DataFrame, suffix: str = "_right") -> DataFrame:
    """The right frame with every column name the left one also has renamed."""
    taken = {c.lower() for c in left.columns}
    names = []
    for column in right.columns:
        name = column
        while name.lower() in taken:
            name += suffix
        taken.add(name.lower())
        names.append(name)
    return right.toDF(*names)


def join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str] | None = None,
    how: str = "equijoin",
    *,
    suffix: str = "_right",
) -> DataFrame:
    """Join on key lists paired by position; both sides keep all columns, right duplicates get a suffix.

    No side is forced to be broadcast: Spark does that below its size threshold, and AQE splits a hot key of a
    sort-merge join.
    """
    kind = JOIN_TYPES.get(how.lower())
    if kind is None:
        raise ValueError(f"unknown join type {how!r}; use one of {', '.join(JOIN_TYPES)}")
    right_keys = list(left_keys if right_keys is None else right_keys)
    if not left_keys or len(left_keys) != len(right_keys):
        raise ValueError(f"join keys must pair up: {list(left_keys)} with {right_keys}")
    renamed = suffix_duplicates(left, right, suffix)
    position = {name: i for i, name in enumerate(right.columns)}
    pairs = [
        left[f"`{a}`"] == renamed[f"`{renamed.columns[position[b]]}`"] for a, b in zip(left_keys, right_keys, strict=True)
    ]
    return left.join(renamed, reduce(lambda a, b: a & b, pairs), kind)


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return top_per_key(df, keys, order, 1)


# No more hot keys than this are salted.
HOT_KEYS = 10_000


def _salt(df: DataFrame, salts: int) -> Column:
    """A number per row that a repeated task gives again: the row's content and the partition it is in.

    The partition keeps exact copies of one row apart.
    """
    return F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in df.columns]), F.lit(salts))


# A hot key is one with at least this share of the rows, so there are at most 1 / share of them.
HOT_SHARE = 0.01
SPREAD = 1024


def join_unique(df: DataFrame, unique: DataFrame, keys: Sequence[str], hot_share: float = HOT_SHARE) -> DataFrame:
    """Left join to a frame with one row per key, without sending a hot key's rows to one task.

    The right rows of hot keys, at most ``1 / hot_share`` of them, are broadcast. Left rows answered that way
    get a salt the right side does not have, so the shuffle for all other keys spreads them evenly. NULL keys
    match NULL keys.
    """
    keys = list(keys)
    values = [c for c in unique.columns if c not in keys]
    names = [f"_k{i}" for i in range(len(keys))]
    counts = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows").alias("_all"))
    heavy = counts.join(F.broadcast(total)).where(F.col("_rows") >= hot_share * F.col("_all")).select(*names)
    side = unique.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.struct(*values).alias("_value"))

    def same(a: Sequence[str], b: Sequence[str]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(m).eqNullSafe(F.col(n)) for m, n in zip(a, b, strict=True)])

    marked = heavy.select(*[F.col(n).alias(f"_h{n}") for n in names])
    heavy_names = [f"_h{n}" for n in names]
    found = side.join(F.broadcast(marked), same(names, heavy_names)).select(*names, "_value")
    # Hot keys the right side lacks stay in the list, so their rows are spread as well.
    hot = marked.join(F.broadcast(found), same(heavy_names, names), "left").select(
        *heavy_names, F.col("_value").alias("_hot_value"), F.lit(True).alias("_is_hot")
    )
    answered = df.join(F.broadcast(hot), same(keys, heavy_names), "left").drop(*heavy_names)
    salt = F.when(F.col("_is_hot"), _salt(df, SPREAD) + 1).otherwise(0)
    salted = answered.withColumn("_salt", salt)
    # Always 0, but worked out per row: as a literal the optimizer would take it out of the join keys, and the
    # rows of a hot key would be shuffled together after all.
    rest = side.withColumn("_cold", F.pmod(F.xxhash64(*names), F.lit(1)))
    out = salted.join(rest, same(keys, names) & (F.col("_salt") == F.col("_cold")), "left")
    value = F.when(F.col("_is_hot"), F.col("_hot_value")).otherwise(F.col("_value"))
    out = out.withColumn("_got", value)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_got.`{c}`").alias(c) for c in values])


def lookup(df: DataFrame, dim: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """``df`` with columns of a dimension behind its own. A key the dimension holds twice is settled by ``order``, so rows
    never multiply. A NULL key finds nothing.

    The join is the same whatever the dimension's size: Spark broadcasts it below its byte threshold, and AQE splits
    hot keys above.
    """
    narrow = dim.select(*dict.fromkeys([*keys, *columns]))
    if order:
        narrow = one_per_key(dim, keys, order).select(*narrow.columns)
    else:
        narrow = narrow.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_v")).select(*keys, "_v.*")
    clash = [c for c in columns if c in df.columns and c not in keys]
    if clash:
        raise ValueError(f"lookup would overwrite {clash}")
    return df.join(narrow, list(keys), "left").select(*[F.col(f"`{c}`") for c in dict.fromkeys([*df.columns, *columns])])


def merge(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Upsert by primary key: changed rows replace base rows, new keys are added; ``order`` picks among several changes to
    one key. Rows whose key holds a NULL match none and stay, on both sides. One join, so both sides are read once."""
    names = list(dict.fromkeys([*base.columns, *changes.columns]))
    old = base.select(F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("_old"), *[F.col(f"`{k}`").alias(f"_o{i}") for i, k in enumerate(keys)])
    latest = one_per_key(changes, keys, order)
    new = latest.select(F.struct(*[F.col(f"`{c}`") for c in changes.columns]).alias("_new"), *[F.col(f"`{k}`").alias(f"_n{i}") for i, k in enumerate(keys)])
    both = old.join(new, reduce(lambda a, b: a & b, [F.col(f"_o{i}") == F.col(f"_n{i}") for i in range(len(keys))]), "full")

    def value(c: str) -> Column:
        had = F.col(f"_old.`{c}`") if c in base.columns else F.lit(None)
        return F.when(F.col("_new").isNotNull(), F.col(f"_new.`{c}`") if c in changes.columns else F.lit(None)).otherwise(had).alias(c)

    return both.select(*[value(c) for c in names])


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int, hot: DataFrame, how: str = "inner"
) -> DataFrame:
    """Equi join in which the rows of hot keys are spread over ``salts`` tasks.

    ``hot`` lists the hot keys (see ``audit.hot_keys``). Only their right rows are repeated, once per salt, so
    the cost of salting does not touch the other keys. Right and full joins would repeat unmatched right rows.
    """
    kind = JOIN_TYPES.get(how.lower())
    if kind not in ("inner", "left", "leftsemi", "leftanti"):
        raise ValueError("salting keeps left rows whole: use inner, left, leftsemi or leftanti")
    keys = list(keys)
    listed = cut_lineage(hot.select(*keys).distinct())
    # The list is broadcast, so its size is proven first: a key with a share of s leaves room for 1 / s others at most.
    if listed.limit(HOT_KEYS + 1).count() > HOT_KEYS:
        raise ValueError(f"more than {HOT_KEYS} hot keys: ask for a larger share")
    marks = [f"_h{i}" for i in range(len(keys))]
    flag = listed.select(*[F.col(k).alias(m) for k, m in zip(keys, marks, strict=True)], F.lit(True).alias("_hot"))

    def flagged(df: DataFrame) -> DataFrame:
        # NULL keys are often the hottest; they match nothing but must be spread too.
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, marks, strict=True)])
        return df.join(F.broadcast(flag), same, "left").drop(*marks)

    spread = _salt(left, salts).cast("int")
    salted_left = flagged(left).withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_right = flagged(right).withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted_left.join(salted_right, [*keys, "_salt"], kind).drop("_salt")


def latest_before(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str]
) -> DataFrame:
    """As-of join by day: each left row with the last right row of an earlier day.

    Both sides shrink to one row per key and day before the ordered step, which so holds at most one row per
    calendar day and side for any key, however many rows the key has. No pairs are formed.
    """
    keys = list(keys)
    value = F.struct(F.col(right_time), *[F.col(c) for c in columns])
    per_day = right.groupBy(*keys, F.to_date(right_time).alias("_day")).agg(
        F.max_by(value, F.struct(F.col(right_time), *[F.col(c) for c in columns])).alias("_value")
    )
    asked = left.select(*keys, F.to_date(left_time).alias("_day")).distinct()
    both = per_day.withColumn("_ask", F.lit(False)).unionByName(
        asked.withColumn("_ask", F.lit(True)), allowMissingColumns=True
    )
    # On the same day the question sorts before the value, so only earlier days answer it.
    earlier = Window.partitionBy(*keys).orderBy("_day", F.desc("_ask")).rowsBetween(Window.unboundedPreceding, -1)
    answered = both.withColumn("_found", F.last("_value", ignorenulls=True).over(earlier)).where("_ask")
    answered = answered.select(*keys, "_day", "_found")
    dated = left.withColumn("_day", F.to_date(left_time))
    out = join_unique(dated, answered, [*keys, "_day"])
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"_found.{c}") for c in [right_time, *columns]])


def latest_at(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    columns: Sequence[str],
    *,
    or_equal: bool = True,
    pieces: int | None = None,
) -> DataFrame:
    """As-of join at any instant: each left row with the last right row of its key at its time or before it.

    Of right rows at one instant the one with the largest ``columns`` counts; ``or_equal=False`` leaves rows at the very
    instant out. Both sides are put in one order of key and time, cut into ranges; each range is gone through once, and
    the last right row of each range is carried to those behind it. So a key of any size takes many tasks, and no
    pairs are formed. Both inputs are computed once. A NULL key or time finds nothing and is found by nothing.
    """
    names, keys = list(keys), [f"_k{n}" for n in range(len(keys))]
    taken = [F.col(f"`{c}`").alias(k) for c, k in zip(names, keys, strict=True)]
    # At one instant a question comes behind the rows that may answer it.
    asks, says = (1, 0) if or_equal else (0, 1)
    value = F.struct(F.col(f"`{right_time}`").alias("c0"), *[F.col(f"`{c}`").alias(f"c{n + 1}") for n, c in enumerate(columns)])
    known = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in [*names, right_time]])
    rows = F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(left.columns)])
    questions = left.select(*taken, F.col(f"`{left_time}`").alias("_t"), F.lit(asks).alias("_side"), rows.alias("_row"))
    answers = right.where(known).select(*taken, F.col(f"`{right_time}`").alias("_t"), F.lit(says).alias("_side"), value.alias("_value"))
    both = cut_lineage(questions.unionByName(answers, allowMissingColumns=True))

    by = [*keys, "_t", "_side", "_value"]
    cut, n = in_pieces(both, by, pieces)
    here = Window.partitionBy(PIECE, *keys).orderBy("_t", "_side", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.repartitionById(n, F.col(PIECE)).withColumn("_last", F.last("_value", ignorenulls=True).over(here))
    # One row per range: its last right row. Behind it, only rows of the same key may use it.
    tail = F.max_by(F.struct(*keys, "_value"), F.when(F.col("_value").isNotNull(), F.struct(*by)))
    tails = cut.groupBy(PIECE).agg(tail.alias("_tail"))
    before = Window.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    heads = tails.select(PIECE, F.last("_tail", ignorenulls=True).over(before).alias("_head"))
    out = local.where(F.col("_row").isNotNull()).join(F.broadcast(heads), PIECE, "left")
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_head.{k}") for k in keys])
    found = F.when(F.col("_t").isNotNull(), F.coalesce("_last", F.when(same, F.col("_head._value"))))
    out = out.select("_row", found.alias("_found"))
    mine = [F.col(f"_row.c{n}").alias(c) for n, c in enumerate(left.columns)]
    return out.select(*mine, *[F.col(f"_found.c{n}").alias(c) for n, c in enumerate([right_time, *columns])])
