"""Registration of queries and shared rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.fixtures import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Views(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"duplicate query: {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Six decimals; the nudge makes decimal ties round alike whatever the order of the sums."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            column = F.round(column.cast("double") + F.lit(1e-9), 6) + F.lit(0.0)
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("long")
        out.append(column.alias(field.name))
    return df.select(*out)


def r6(expression: str, name: str | None = None) -> str:
    """The same rounding as SQL text."""
    text = f"(round(CAST(({expression}) AS DOUBLE) + CAST(1e-9 AS DOUBLE), 6) + CAST(0.0 AS DOUBLE))"
    return f"{text} AS {name or expression}"


def big(expression: str, name: str | None = None) -> str:
    return f"CAST({expression} AS BIGINT) AS {name or expression}"


def r6s(*names: str) -> str:
    return ", ".join(r6(n) for n in names)


def bigs(*names: str) -> str:
    return ", ".join(big(n) for n in names)
