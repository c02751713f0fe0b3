"""Registered queries: a Spark job over the driver tables, and where possible the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.plans.testbed import Testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str | Callable[[], str]] = {}


def query(name: str, oracle: str | Callable[[], str] | None = None):
    """Register a function of a Testbed under a name."""

    def register(fn: Callable[[Testbed], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(Testbed(spark, sf_dir)))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def present(df: DataFrame) -> DataFrame:
    """Plain columns: whole numbers as BIGINT, doubles rounded to 6, times and dates as text, lists joined."""
    cols = []
    for field in df.schema.fields:
        c, t = F.col(f"`{field.name}`"), field.dataType
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            c = F.floor(c.cast("double") * 1e6 + 0.5).cast("double") / F.lit(1e6)
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        cols.append(c.alias(field.name))
    return df.select(*cols)


def load() -> None:
    """Import the modules that register queries."""
    from talkmill.plans import queries_analytics, queries_entities, queries_ingest, queries_search, queries_store  # noqa: F401


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    load()
    return {name: o() if callable(o) else o for name, o in ORACLES.items()}
