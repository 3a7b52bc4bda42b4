"""Aggregation along time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.scalar import null_sentinels
from gridspark.operators.scan import small_quantiles


def annual_percentile(daily: DataFrame, value: str = "q", q: float = 0.1, keys: Sequence[str] = ("r", "c"),
                      year: str = "yr") -> DataFrame:
    """Interpolated percentile of a cell's valid daily values in each year; negatives are missing."""
    clean = daily.select(*keys, year, null_sentinels(F.col(value), negative_is_null=True).alias(value))
    return small_quantiles(clean, value, {"p": q}, [*keys, year])


def period_mean(annual: DataFrame, value: str = "p", keys: Sequence[str] = ("r", "c")) -> DataFrame:
    """Mean over the years a cell has a value in."""
    return annual.groupBy(*keys).agg(F.avg(value).alias(value), F.count(value).alias("n_years"))


def year_range_mean(cube: DataFrame, first: int, last: int, value: str = "v", time: str = "yr",
                    keys: Sequence[str] = ("r", "c")) -> DataFrame:
    """Mean layer of the years in [first, last]; a table without time passes through."""
    if time not in cube.columns:
        return cube.select(*keys, value)
    return cube.where(F.col(time).between(first, last)).groupBy(*keys).agg(F.avg(value).alias(value))


def recent_window(df: DataFrame, year: str = "yr", n: int = 5) -> DataFrame:
    """Rows of the last ``n`` years of the table.

    The newest year is read first, so that the filter is a constant the scan can use.
    """
    newest = df.agg(F.max(year)).first()[0]
    return df.where(F.lit(False)) if newest is None else df.where(F.col(year) > newest - n)


def period_label(year: str = "yr") -> Column:
    """``2020`` or ``1991_2020``, as an aggregate expression."""
    first, last = F.min(year).cast("string"), F.max(year).cast("string")
    return F.when(F.min(year) == F.max(year), first).otherwise(F.concat(first, F.lit("_"), last))
