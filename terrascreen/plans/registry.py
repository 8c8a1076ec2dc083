"""Query registration and the tables a query may read."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

PLANS: dict[str, Callable[["Tables"], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Tables:
    """Parquet tables of one data folder, read lazily and once per query."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._cache[name]

    @cached_property
    def views(self):
        from terrascreen.plans.views import Views

        return Views(self)


def query(name: str, sql: str | None = None):
    """Register a plan, with the SQL giving the same rows where SQL can express it."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"duplicate query {name}")
        PLANS[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return register


def load_all() -> None:
    """Import every plan module."""
    from terrascreen.plans import audits, comparisons, expressions, guards, joins, landing, linear, polygons, reports, seasons, survey  # noqa: F401
