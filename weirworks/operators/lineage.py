"""Graphs of nodes and edges: reachability, depth and cycles.

Each round is one join on the edges that still matter; its result is written to the checkpoint folder so that
plans stay small and a lost executor repeats one round at most. Loops end when a round finds nothing new.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirworks.session import cut_lineage, scratch_path


COMPACT_EVERY = 8


def _walk(edges: DataFrame, anchors: DataFrame, source: str, target: str) -> DataFrame:
    """Nodes reached from the anchors by following ``source -> target``, anchors included."""
    steps = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
    visited = cut_lineage(anchors.select("node").distinct())
    frontier, rounds = visited, 0
    while True:
        # Distinct first: a node with very many edges then meets one frontier row, and its rows are not regrouped.
        ahead = steps.join(frontier.withColumnRenamed("node", "_from"), "_from", "leftsemi").select(F.col("_to").alias("node")).distinct()
        frontier = cut_lineage(ahead.join(visited, "node", "leftanti"))
        if frontier.isEmpty():
            return visited
        rounds += 1
        # The written rounds are read side by side; now and then they are written as one.
        visited = visited.unionByName(frontier)
        visited = cut_lineage(visited) if rounds % COMPACT_EVERY == 0 else visited


def reachable(edges: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes up and down from the anchors, and the edges on the way. No anchors give empty frames.

    ``edges`` has ``src`` and ``dst``, ``anchors`` has ``node``. Cycles are safe: a node is visited once.
    """
    edges = cut_lineage(edges.select("src", "dst").distinct())
    down = _walk(edges, anchors, "src", "dst")
    up = _walk(edges, anchors, "dst", "src")
    nodes = down.unionByName(up).distinct()
    downward = edges.join(down.withColumnRenamed("node", "src"), "src", "leftsemi")
    upward = edges.join(up.withColumnRenamed("node", "dst"), "dst", "leftsemi")
    return nodes, downward.select("src", "dst").unionByName(upward.select("src", "dst")).distinct()


# Tables of one round that are written as one before they are merged with larger ones.
RUNS = 8
PART = "_part"


def _parts(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` written by a hash of ``key``, so that later reads for few keys leave most files aside."""
    path = scratch_path(df.sparkSession, "graph")
    numbered = df.withColumn(PART, F.pmod(F.hash(key), F.lit(n)))
    numbered.repartition(n, PART).write.partitionBy(PART).parquet(path)
    return df.sparkSession.read.schema(numbered.schema).parquet(path)


def _near(table: DataFrame, keys: DataFrame, key: str, n: int) -> DataFrame:
    """The files of ``table`` that can hold one of ``keys`` (column node). At most ``n`` numbers pass through the driver."""
    found = [r[0] for r in keys.select(F.pmod(F.hash("node"), F.lit(n))).distinct().collect()]
    return table.where(F.col(PART).isin(found)).drop(PART)


class _Log:
    """What rounds have written, in tables of growing size: a row is rewritten once per size, not once per round."""

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = []

    def add(self, df: DataFrame, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(df)
        if len(self.levels[level]) == RUNS:
            whole = cut_lineage(reduce(DataFrame.unionByName, self.levels[level]))
            self.levels[level] = []
            self.add(whole, level + 1)

    def rows(self) -> DataFrame | None:
        every = [df for level in self.levels for df in level]
        return reduce(DataFrame.unionByName, every) if every else None


def depths(edges: DataFrame) -> DataFrame:
    """``(node, depth)``: the longest path from any source; NULL for nodes on or behind a cycle.

    A node leaves once all edges to it have left, and the round it leaves in is its depth. A round takes the edges of the
    nodes that left in the one before, sums up what their targets lose, and writes what is left of those targets:
    nodes that nothing touches are neither read nor written again. What never leaves is what cycles hold back. Repeated
    edges count once; edges without a node at either end are ignored.
    """
    n = min(1024, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edges = _parts(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "src", n)
    held = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("left"))
    sources = edges.select(F.col("src").alias("node")).distinct().withColumn("left", F.lit(0).cast("long"))
    degrees = _parts(held.unionByName(sources).groupBy("node").agg(F.sum("left").alias("left")), "node", n)
    waiting, done = _Log(), _Log()
    leaving, depth = cut_lineage(degrees.where("left = 0").select("node")), 0
    done.add(leaving.withColumn("depth", F.lit(depth)))
    while True:
        lost = _near(edges, leaving, "src", n).join(leaving.withColumnRenamed("node", "src"), "src", "leftsemi")
        lost = cut_lineage(lost.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("lost")))
        if lost.isEmpty():
            break
        # What was left of a node last is the least of all that was ever written for it.
        known = _near(degrees, lost, "node", n)
        earlier = waiting.rows()
        known = known if earlier is None else known.unionByName(earlier)
        now = lost.join(known, "node").groupBy("node").agg((F.min("left") - F.max("lost")).alias("left"))
        now = cut_lineage(now)
        leaving, depth = now.where("left = 0").select("node"), depth + 1
        if leaving.isEmpty():
            break
        done.add(leaving.withColumn("depth", F.lit(depth)))
        waiting.add(now.where("left > 0"))
    reached = done.rows()
    stuck = degrees.select("node").join(reached, "node", "leftanti").withColumn("depth", F.lit(None).cast("int"))
    return reached.unionByName(stuck)


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle or behind one."""
    return depths(edges).where("depth IS NULL").select("node")


def missing_sources(edges: DataFrame, targets: DataFrame, sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources that feed the target nodes and have no data on record."""
    feeding = _walk(edges, targets, "dst", "src")
    return feeding.join(sources.select("node").distinct(), "node", "leftsemi").join(manifest.select("node").distinct(), "node", "leftanti")
