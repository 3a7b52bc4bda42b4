"""Distribution summaries, counts and multi-scope reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators.scan import exact_quantiles


def to_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), key: str = "feature", value: str = "x") -> DataFrame:
    """Columns to rows."""
    wanted = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return wanted.unpivot(list(keep), list(cols), key, value)


def to_wide(df: DataFrame, keys: Sequence[str], key: str, value: str, names: Sequence) -> DataFrame:
    """Rows to columns; ``names`` are given, so no extra pass has to find them."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(key) == n, F.col(value))).alias(str(n)) for n in names])


def quantiles(df: DataFrame, cols: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    return exact_quantiles(to_long(df, cols), "x", probs, ["feature"])


def rounded_limit(q: Column, minimum: float = 0.01) -> Column:
    """A display limit: the next hundredth above the quantile, at least ``minimum``."""
    return F.ceil(F.round(F.greatest(q, F.lit(minimum)) * 100.0, 6)) / 100.0


def variable_summary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Counts, distinct values, range and percentiles of each feature."""
    long = to_long(df, features)
    base = long.groupBy("feature").agg(
        F.count("x").alias("n"), F.sum(F.col("x").isNull().cast("long")).alias("n_missing"), F.min("x").alias("min"),
        F.max("x").alias("max"), F.avg("x").alias("mean"),
    )
    unique = long.where("x IS NOT NULL").groupBy("feature", "x").agg(F.lit(1).alias("_o")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_unique")
    )
    middle = exact_quantiles(long, "x", {"p01": 0.01, "median": 0.5, "p99": 0.99}, ["feature"])
    return base.join(unique, "feature").join(middle, "feature")


def histogram(df: DataFrame, x: str, bins: int = 55, trim: float = 0.005) -> DataFrame:
    """Counts and shares in equal bins over the trimmed range; the last bin is closed on the right."""
    limits = exact_quantiles(df, x, {"low": trim, "high": 1.0 - trim}).first()
    low, high = F.lit(limits["low"]), F.lit(limits["high"])
    value = F.col(x)
    inside = df.where(value.between(low, high))
    width = (high - low) / F.lit(float(bins))
    bin_ = F.least(F.floor((value - low) / width), F.lit(bins - 1).cast("long"))
    counts = inside.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = inside.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share_pct", F.col("n") / total * 100.0)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def overall_and_by(df: DataFrame, scopes: Mapping[str, Sequence[str]], aggs: Sequence[Column]) -> DataFrame:
    """The same statistics at several levels in one pass, labelled by ``scope``.

    ``scopes`` maps a label to its grouping columns; columns outside a scope are NULL.
    """
    columns = list(dict.fromkeys(c for cols in scopes.values() for c in cols))
    sets = [[F.col(c) for c in cols] for cols in scopes.values()]
    grouped = df.groupingSets(sets, *columns).agg(F.grouping_id().alias("_gid"), *aggs)
    label = F.lit(None).cast("string")
    for name, cols in scopes.items():
        gid = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cols)
        label = F.when(F.col("_gid") == gid, name).otherwise(label)
    return grouped.withColumn("scope", label).drop("_gid")


def fold_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.count(value).alias("n_folds"),
    )
