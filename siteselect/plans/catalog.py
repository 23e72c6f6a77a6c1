"""Every registered query of the library, by the id of its operator, with the SQL that it equals where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteselect.plans.fixtures import fixture, table, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Given tables and fixtures of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        from siteselect.plans.fixtures import FIXTURES

        return fixture(self.spark, self.dir, name) if name in FIXTURES else table(self.spark, self.dir, name)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_fixtures(sql)
        return fn

    return register


def load() -> None:
    """Import the modules that register queries."""
    from siteselect.plans import clean_queries, ml_queries, score_queries, shape_queries, source_queries, spatial_queries  # noqa: F401
