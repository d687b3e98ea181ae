"""The query registry and access to the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from weirworks.plans.views import VIEWS
from weirworks.session import prepare, spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Data:
    """The given tables under one folder, and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def wide(self, name: str, key: str) -> DataFrame:
        """The table for work that is costly per row, on all cores even when it is a single small file."""
        return spread(getattr(self, name), key)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)

    def view(self, name: str) -> DataFrame:
        text, used = VIEWS[name]
        for source in used:
            (self.view(source) if source in VIEWS else self.table(source)).createOrReplaceTempView(source)
        return self.spark.sql(text)


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, *views: str):
    """Register a function of ``Data`` with its check; ``views`` are put in front of the SQL as CTEs."""

    def add(fn: Callable[[Data], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(lambda spark, folder: fn(Data(spark, folder)), with_views(oracle, views))
        return fn

    return add


def with_views(oracle: str | None, views: tuple[str, ...]) -> str | None:
    if oracle is None or not views:
        return oracle
    text = oracle.strip()
    heads: dict[str, str] = {}

    def need(name: str) -> None:
        for source in VIEWS[name][1]:
            if source in VIEWS:
                need(source)
        heads.setdefault(name, VIEWS[name][0])

    for v in views:
        need(v)
    ctes = ",\n".join(f"{n} AS ({t})" for n, t in heads.items())
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"
