"""Registry of named queries over the test tables, each with an independent SQL statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacanta.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def comparable(df: DataFrame) -> DataFrame:
    """Integers as bigint and floats rounded to 6 places, so engines can be compared by value."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.DecimalType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        out.append(c.alias(f.name))
    return df.select(out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same result as plain SQL over the tables."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: comparable(fn(tune(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
