"""Table access, shared views and the query registry.

A view is plain SQL that Spark and DuckDB both accept, so the Spark query and
its twin start from the same rows; the operator under test never appears in a
view.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def _words(sql: str) -> set[str]:
    return set(re.findall(r"[A-Za-z_]\w*", sql))


def view_order(sql: str) -> list[str]:
    """Views the text needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        words = _words(text)
        for name in VIEWS:
            if name in words and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


class Tables:
    """Lazy access to the tables of one folder: ``t.part``, ``t.sql(...)``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            if name in VIEWS:
                self._frames[name] = self.sql(VIEWS[name])
            elif name in BASE_TABLES:
                self._frames[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._frames[name]

    def spread(self, name: str) -> DataFrame:
        """A table for row-wise heavy work: a scan with fewer partitions than cores is spread first.

        A large table has more splits than cores, so nothing is shuffled there.
        """
        df = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

    def clustered(self, name: str, key: str, keep: tuple[str, ...] = ()) -> Tables:
        """Access with a table dealt by ``key`` first: views that group and number its rows by that key need no other shuffle.

        The tables and views of ``keep`` stay as they are here; every other one is looked up anew.
        """
        dealt = Tables(self.spark, self.path)
        dealt._frames = {name: getattr(self, name).repartition(key), **{k: getattr(self, k) for k in keep}}
        return dealt

    def sql(self, text: str) -> DataFrame:
        """Run SQL over the tables and views it names."""
        words = _words(text)
        used = [n for n in [*VIEWS, *BASE_TABLES] if n in words]
        for name in used:
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(text)


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` with its DuckDB twin."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def oracle_text(sql: str) -> str:
    """The twin with the shared views it needs as CTEs."""
    body = sql.strip()
    recursive = body.lower().startswith("with recursive ")
    ctes = [f"{name} AS ({VIEWS[name]})" for name in view_order(body)]
    if not ctes:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body.lower().startswith("with "):
        return head + ",\n".join(ctes) + ",\n" + body[len("with recursive ") if recursive else 5 :]
    return head + ",\n".join(ctes) + "\n" + body
