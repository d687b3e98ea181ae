"""A Merkle manifest of a table that stores few of its levels and recomputes the others when a proof is asked for.

Rows are leaves. Within a group (a language, say) they stand in order; every ``FANOUT`` consecutive nodes become the
digest of their digests until one node is left, the group's subroot. Subroots, ordered by group, become the root the
same way. Only the leaves and every ``EVERY``-th level are written. Each written node above the leaves stands for an
aligned subtree of ``FANOUT ** EVERY`` written nodes below it; a proof regenerates the levels between from those, takes
the siblings and lets the levels go. So storage grows by a 511th part of the leaves, and no task holds more than the
nodes of one subtree, whatever the size of a group.

Nulls in any column are part of a leaf (``-``). Rows that share an order value are ordered by their digests, so exact
copies are leaves of their own with equal subtrees' results. Empty texts are values, not nulls. An empty table has no
root and no proofs. Other columns of the table may have any names; only those asked for are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.llm.common import col
from weirworks.llm.places import never_null, placed
from weirworks.session import cut_lineage

FANOUT, EVERY = 8, 3
SUBTREE = FANOUT**EVERY


def digest(value: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(value, 256)


def field(value: Column) -> Column:
    """One value of a leaf: its number of bytes in UTF-8, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


@dataclass(frozen=True)
class Tree:
    """The written levels of the trees of all groups: leaves first, then every ``EVERY``-th level.

    Each level has ``grp``, ``place``, ``size`` (nodes of the group in this level), ``digest`` and ``extra`` (of leaves).
    ``tops`` has one row per group: ``grp``, ``top`` and ``level``, the index of the last written level of the group.
    """

    levels: tuple[DataFrame, ...]
    tops: DataFrame


def _above(nodes: Column, alone: Column) -> Column:
    """The next level: digests of runs of ``FANOUT`` nodes. A node that is the only one of its group stays."""
    runs = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(nodes) / FANOUT).cast("int") - 1),
        lambda n: digest(F.array_join(F.slice(nodes, n * FANOUT + 1, F.lit(FANOUT)), "")),
    )
    return F.when(alone & (F.size(nodes) == 1), nodes).otherwise(runs)


def _subtrees(level: DataFrame) -> DataFrame:
    """One row per aligned subtree: its written nodes in order and, regenerated from them, the levels ``l0`` to the top."""
    held = F.sort_array(F.collect_list(F.struct("place", "digest", "extra"))).alias("held")
    block = F.shiftright("place", (SUBTREE - 1).bit_length()).alias("block")
    out = level.groupBy("grp", block).agg(held, F.first("size").alias("size"))
    out = out.withColumn("alone", F.col("size") <= SUBTREE).withColumn("l0", F.transform("held", lambda x: x["digest"]))
    for n in range(EVERY):
        out = out.withColumn(f"l{n + 1}", _above(F.col(f"l{n}"), F.col("alone")))
    return out


def build(leaves: DataFrame, order: Sequence[str]) -> Tree:
    """The tree of ``leaves``, which have ``grp`` (not null), ``digest``, ``extra`` (a struct to carry along) and the columns of ``order``."""
    level = placed(leaves, "grp", [*order, "digest"]).select("grp", "place", "size", "digest", "extra")
    levels, tops = [level], []
    most = level.agg(F.max("size")).first()[0] or 0
    while True:
        subtrees = _subtrees(level).select("grp", "block", "size", "alone", F.element_at(f"l{EVERY}", 1).alias("digest"))
        above = cut_lineage(subtrees)
        tops.append(above.where("alone").select("grp", F.col("digest").alias("top"), F.lit(len(levels) - 1).alias("level")))
        if most <= SUBTREE:
            break
        most = -(-most // SUBTREE)
        level = above.where("NOT alone").select(
            "grp", F.col("block").alias("place"), F.ceil(F.col("size") / SUBTREE).alias("size"), "digest", F.lit(None).cast("int").alias("extra")
        )
        levels.append(level)
    every = tops[0]
    for t in tops[1:]:
        every = every.unionByName(t)
    return Tree(tuple(levels), every)


def _siblings(n: int, at: Column, alone: Column) -> Column:
    """In level ``n`` of a subtree, what stands left and right of the ancestor of node ``at`` in its run."""
    nodes, here = F.col(f"l{n}"), F.floor(at / FANOUT**n).cast("int")
    inside = F.pmod(here, F.lit(FANOUT))
    return F.struct(
        F.array_join(F.slice(nodes, here - inside + 1, inside), "").alias("left"),
        F.array_join(F.slice(nodes, here + 2, FANOUT - 1 - inside), "").alias("right"),
        (~(alone & (F.size(nodes) == 1))).alias("joined"),
    )


def paths(tree: Tree, upper: DataFrame) -> DataFrame:
    """Every leaf (``grp``, ``place``, ``digest``, ``extra``) with its ``path`` to the root, an array of left and right siblings.

    ``upper`` has a row per group: ``grp``, ``path`` from its top on, and other columns, which are carried along.
    """
    more = [c for c in upper.columns if c not in ("grp", "path")]
    upper = upper.withColumn("block", F.lit(0).cast("long"))
    below = None
    for n in reversed(range(len(tree.levels))):
        ends = upper.join(tree.tops.where(F.col("level") == n).select("grp"), "grp", "left_semi")
        over = ends if below is None else ends.unionByName(below.select("grp", F.col("place").alias("block"), "path", *more))
        blocks = _subtrees(tree.levels[n]).join(over.withColumnRenamed("path", "up"), ["grp", "block"])

        def node(x: Column, at: Column) -> Column:
            steps = F.filter(F.array(*[_siblings(k, at, F.col("alone")) for k in range(EVERY)]), lambda s: s["joined"])
            path = F.transform(steps, lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right")))
            return F.struct(x["place"].alias("place"), x["digest"].alias("digest"), x["extra"].alias("extra"), F.concat(path, F.col("up")).alias("path"))

        below = blocks.select("grp", *more, F.explode(F.transform("held", node)).alias("node")).select("grp", "node.*", *more)
    return below


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf digest and its path give."""
    return F.aggregate(path, start, lambda held, step: digest(F.concat(step["left"], held, step["right"])))


def siblings_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def manifest(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Every leaf with its path, its group's ``subroot`` and the ``root``; ``leaves`` as ``build`` takes them.

    Digests are written before they are put in order, so that the cut into ranges does not read the texts again.
    """
    tree = build(cut_lineage(leaves), order)
    groups = tree.tops.select(F.lit("all").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("digest"), F.struct("grp").alias("extra"))
    over = build(groups, ["name"])
    start = F.array().cast("array<struct<left:string,right:string>>").alias("path")
    root = over.tops.select("grp", start, F.col("top").alias("root"))
    ends = paths(over, root).select(F.col("extra.grp").alias("grp"), F.col("digest").alias("subroot"), "path", "root")
    return paths(tree, cut_lineage(ends))


def rows_as_leaves(df: DataFrame, columns: Sequence[str], group: str, order: str, forged: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Leaves of ``df`` over ``columns``, for ``manifest``; ``extra`` holds ``order`` and ``forged``.

    ``forged`` is the digest of the row with other values in the columns that it names, for rows where ``where`` holds;
    else null.
    """
    true = leaf([col(df, c) for c in columns])
    extra = [col(df, order).alias(order)]
    if forged:
        fake = leaf([forged.get(c, col(df, c)) for c in columns])
        extra.append(F.when(where, fake).alias("forged"))
    return df.select(never_null(col(df, group)).alias("grp"), col(df, order).alias("by"), true.alias("digest"), F.struct(*extra).alias("extra"))
