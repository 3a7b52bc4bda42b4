"""Whole-layer operations: selection of years, diagnostics, rescaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.scalar import clip, is_finite
from gridspark.operators.scan import exact_quantiles


def select_year(cube: DataFrame, year: int, time: str = "yr") -> DataFrame:
    """The layer of one year; fails when the cube has no such year."""
    layer = cube.where(F.col(time) == year)
    if layer.isEmpty():
        raise ValueError(f"year {year} is not in the cube")
    return layer.drop(time)


def missing_years(cube: DataFrame, first: int, last: int, time: str = "yr") -> DataFrame:
    wanted = cube.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(time))
    return wanted.join(cube.select(time).distinct(), time, "left_anti")


def layer_stats(layer: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts, range, mean, median and 90th percentile per layer."""
    x = F.when(is_finite(F.col(value)), F.col(value))
    base = layer.groupBy(*by).agg(
        F.count(x).alias("n_valid"),
        F.sum(F.when(x.isNull(), 1).otherwise(0)).alias("n_missing"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.avg(x).alias("mean"),
    )
    middle = exact_quantiles(layer.withColumn(value, x), value, {"median": 0.5, "p90": 0.9}, by)
    if by:
        return base.join(middle, list(by), "left")
    return base.withColumn("median", middle.select("median").scalar()).withColumn("p90", middle.select("p90").scalar())


def axis_profile(layer: DataFrame, axis: str, value: str) -> DataFrame:
    return layer.groupBy(axis).agg(F.avg(value).alias("mean"), F.count(value).alias("n_valid"))


def rescaled_fraction(layer: DataFrame, value: str) -> Column:
    """A share in [0,1]; a layer that exceeds 1.5 anywhere is read as percent."""
    top = layer.agg(F.max(value)).scalar()
    return clip(F.when(top > 1.5, F.col(value) / 100.0).otherwise(F.col(value)))


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def retained_share(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """How many rows survive listwise deletion on ``cols``."""
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    kept = F.sum(complete.cast("long"))
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("n_rows"), kept.alias("n_complete"), (kept / n).alias("share"))
