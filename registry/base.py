"""The registry of queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keysieve.sources.files import balance
from registry.tables import DERIVED, NEEDS, spark_sql

GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# derived tables that take work per row: their source is spread over the cores first
SPREAD = {"files", "trigger_files", "docs", "versions", "graph_versions", "report_docs", "outputs", "findings", "queue_findings"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables by name, and the derived ones."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.given(name)
        for other in NEEDS.get(name, []):
            self[other].createOrReplaceTempView(other)
        text = spark_sql(name)
        for g in GIVEN:
            if f"FROM {g}" in text or f"JOIN {g}" in text:
                source = self.given(g)
                (balance(source) if name in SPREAD else source).createOrReplaceTempView(g)
        return self.spark.sql(text)

    def sql(self, text: str, *names: str) -> DataFrame:
        """SQL over given and derived tables."""
        for n in names:
            self[n].createOrReplaceTempView(n)
        return self.spark.sql(text)


def query(oracle: str | None = None):
    """Register a query under its function's name, with the SQL it must agree with."""
    def add(fn):
        name = fn.__name__
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def give_types(types: dict[str, dict[str, str]]) -> None:
    """Cast columns of the SQL to the types the engine gives them."""
    for name, columns in types.items():
        casts = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in columns.items())
        ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({ORACLES[name]})"


__all__ = ["DERIVED", "GIVEN", "ORACLES", "QUERIES", "Tables", "give_types", "query"]
