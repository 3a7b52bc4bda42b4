"""Rankings, top-n, bins, de-duplication and model choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.scan import SPLIT_ROWS, exact_quantiles, first_n, look_up, numbered


def rank_within(df: DataFrame, by: Sequence[str], order: str, ties: Sequence[str], name: str = "rank") -> DataFrame:
    """1-based rank by ``order`` in each group, ties broken by ``ties``."""
    return numbered(df, order, ties, by, name)


def recommend_variant(ranking: DataFrame, by: str, fallback: str = "baseline") -> DataFrame:
    """The best model per group if its improvement is supported, else the fallback."""
    supported = F.col("improvement_class").isin("clear_improvement", "likely_improvement")
    return ranking.where(F.col("rank") == 1).select(
        by, F.when(supported, F.col("model")).otherwise(fallback).alias("recommended"),
        F.col("model").alias("closest_candidate"), "improvement_class",
    )


def parsimonious_pick(metrics: DataFrame, tol: float = 0.001) -> DataFrame:
    """Among models within ``tol`` of the best R2: fewest features, then lowest RMSE."""
    best = metrics.agg(F.max("r2")).scalar()
    near = metrics.where(F.col("r2") >= best - F.lit(tol))
    return near.orderBy("n_features", "rmse", "model").limit(1)


def share_within(df: DataFrame, value: str, by: Sequence[str], name: str = "share") -> DataFrame:
    totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    return df.join(totals, list(by)).withColumn(name, F.when(F.col("_total") > 0, F.col(value) / F.col("_total"))).drop("_total")


def ranked(df: DataFrame, value: str, ties: Sequence[str], name: str = "rank") -> DataFrame:
    """Rank from the largest value down, over the whole table."""
    return numbered(df.withColumn("_order", -F.col(value)), "_order", ties, name=name).drop("_order")


def topn_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First n rows per group; each task keeps only its own n before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def quantile_bins(df: DataFrame, x: str, n: int = 20, by: Sequence[str] = (), name: str = "bin", hot_rows: int = SPLIT_ROWS) -> DataFrame:
    """Right-closed quantile bins (0-based) with repeated edges dropped; equal values share a bin.

    Edges are a few numbers per group, looked up by the group; the rows of a large group are dealt into parts.
    """
    edges = exact_quantiles(df, x, {f"_e{i}": i / n for i in range(n + 1)}, by, total="_rows")
    packed = edges.select(*by, "_rows", F.sort_array(F.array_distinct(F.array(*[f"_e{i}" for i in range(n + 1)]))).alias("_edges"))
    if by:
        joined = look_up(df.dropna(subset=[x, *by]), packed, list(by), "_rows", hot_rows)
    else:
        joined = df.withColumn("_edges", packed.select("_edges").scalar())
    below = F.size(F.filter("_edges", lambda e: e < F.col(x)))
    return joined.where(F.col(x).isNotNull()).withColumn(name, F.greatest(below - 1, F.lit(0)).cast("long")).drop("_edges")


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key under ``order``, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    kept = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(kept.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def set_checks(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Every name of either side with where it occurs."""
    a = expected.select(key).distinct().withColumn("_e", F.lit(1))
    b = actual.select(key).distinct().withColumn("_a", F.lit(1))
    both = a.join(b, key, "full")
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("present")
    return both.select(key, status.alias("status"))


__all__ = [
    "dedupe", "first_n", "parsimonious_pick", "quantile_bins", "rank_within", "ranked", "recommend_variant", "set_checks",
    "share_within", "top_n", "topn_per_group",
]
