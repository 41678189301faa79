"""Registered queries: a Spark function and, where SQL can express it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from chartweave.scale import spread
from chartweave.session import configure

TEXT_TABLES = ("documents", "conversations", "pages")


@dataclass(frozen=True)
class Tables:
    """Reads the driver tables of one scale factor by attribute."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table) if name in TEXT_TABLES else table


REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under ``name``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(configure(spark), sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        REGISTRY[name] = (run, sql)
        return fn

    return wrap
