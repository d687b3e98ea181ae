"""File, table and connector targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# File formats a target may name, and the words that mean "no compression option".
FORMATS = ("json", "csv", "avro", "orc", "parquet", "glueparquet")
NO_COMPRESSION = ("", "none", "uncompressed")


def write_files(
    df: DataFrame,
    path: str,
    *,
    fmt: str = "parquet",
    compression: str = "",
    partition_keys: Sequence[str] = (),
    mode: str = "append",
    cluster_by_keys: bool = True,
) -> DataFrame:
    """Write files and hand the frame on. Avro needs its Spark package; without it Spark names what is missing.

    With partition keys the rows are rebalanced on them first, so a folder gets a few large files instead of
    one per task, and AQE splits a key that holds a large share of the rows over several tasks.
    """
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unknown file format {fmt!r}; use one of {', '.join(FORMATS)}")
    codec = compression.lower()
    if fmt == "glueparquet":
        fmt, codec = "parquet", codec or "snappy"
    gathered = _gathered(df, partition_keys) if cluster_by_keys else df
    writer = gathered.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if codec not in NO_COMPRESSION:
        writer = writer.option("compression", codec)
    if partition_keys:
        writer = writer.partitionBy(*partition_keys)
    writer.save(path)
    return df


def _gathered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.hint("rebalance", *[F.col(k) for k in keys]) if keys else df


def write_catalog(
    df: DataFrame, database: str, table: str, *, partition_keys: Sequence[str] = (), mode: str = "append", fmt: str = "parquet"
) -> DataFrame:
    """Create the table when it is missing, else add to it or replace it."""
    writer = _gathered(df, partition_keys).write.mode(mode).format(fmt)
    if partition_keys:
        writer = writer.partitionBy(*partition_keys)
    writer.saveAsTable(f"`{database}`.`{table}`")
    return df


@dataclass(frozen=True)
class Receipt:
    node: str
    path: str
    rows: int
    format: str


def write_with_receipt(
    df: DataFrame, node: str, path: str, *, fmt: str = "parquet", partition_keys: Sequence[str] = (), compression: str = ""
) -> Receipt:
    """Overwrite ``path``; the row count is observed by the write itself, without a second pass."""
    seen = Observation(f"{node}-rows")
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    write_files(watched, path, fmt=fmt, compression=compression, partition_keys=partition_keys, mode="overwrite")
    return Receipt(node, path, seen.get["rows"], fmt)


def write_jdbc(df: DataFrame, url: str, table: str, *, mode: str = "append", options: Mapping[str, str] | None = None) -> DataFrame:
    df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table).options(**dict(options or {})).save()
    return df


def write_connector(
    df: DataFrame, fmt: str, *, options: Mapping[str, str] | None = None, path: str | None = None, mode: str = "append"
) -> DataFrame:
    writer = df.write.format(fmt).mode(mode).options(**dict(options or {}))
    writer.save(path) if path else writer.save()
    return df


def spigot(df: DataFrame, path: str, *, top: int = 20, prob: float = 1.0, seed: int = 17) -> DataFrame:
    """Write up to ``top`` rows, each taken with probability ``prob``, as JSON lines; the frame passes through."""
    if not 0 <= top <= 100 or not 0 <= prob <= 1:
        raise ValueError("top must be 0 to 100 and prob 0 to 1")
    df.sample(fraction=prob, seed=seed).limit(top).write.mode("overwrite").json(path)
    return df
