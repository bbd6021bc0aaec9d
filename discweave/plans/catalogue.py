"""Named queries: each operator over the driver's tables, beside SQL that must agree with it.

The tables stand for disc artefacts: an order is a chain of cells (its lines), a customer a
title, a run of forty parts a menu page whose boxes come from the parts' numbers. A query reads
its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t.orders`` reads that table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    """Register a function of :class:`Tables` under its name."""
    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


from discweave.plans import boxes, frames, labels, lookups, media, menus, navigation, positions  # noqa: E402, F401  they register their queries
