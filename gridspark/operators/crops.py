"""Crop-by-cell tables: shares, dominance, top-k values, harmonised layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.scalar import is_finite, safe_divide
from gridspark.operators.scan import exact_quantiles

CELL = ("r", "c")


def with_group_totals(df: DataFrame, by: Sequence[str], **totals) -> DataFrame:
    """Attach per-group aggregates by a join, so a large group is combined before the shuffle."""
    return df.join(df.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()]), list(by))


def topk_mean(crops: DataFrame, value: str, k: int = 5, keys: Sequence[str] = CELL, crop: str = "crop") -> DataFrame:
    """Sum of the k best positive values over k, also where fewer crops exist."""
    positive = crops.where(is_finite(F.col(value)) & (F.col(value) > 0))
    order = Window.partitionBy(*keys).orderBy(F.desc(value), crop)
    top = positive.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k)
    return top.groupBy(*keys).agg((F.sum(value) / F.lit(float(k))).alias("top_mean"), F.count(value).alias("n_crops"))


def crop_share(crop_area: DataFrame, area: str = "area_ha", keys: Sequence[str] = CELL, cropland: str | None = None) -> DataFrame:
    """Share of each crop in its cell's crop area (and in its cropland area); 0 where there is none."""
    out = with_group_totals(crop_area, keys, total_area=F.sum(area))
    out = out.withColumn("share", safe_divide(F.col(area), F.col("total_area"), 0.0))
    if cropland is not None:
        out = out.withColumn("cropland_share", safe_divide(F.col(area), F.col(cropland), 0.0))
    return out


def total_area(crop_area: DataFrame, area: str = "area_ha", system: str = "production_system", keys: Sequence[str] = CELL) -> DataFrame:
    """Area over all crops: the all-systems figure of a crop if present, else irrigated + rainfed."""
    part = lambda s: F.sum(F.when(F.col(system) == s, F.col(area)))
    per_crop = crop_area.groupBy(*keys, "crop").agg(
        F.coalesce(part("A"), F.coalesce(part("I"), F.lit(0.0)) + F.coalesce(part("R"), F.lit(0.0))).alias("_area")
    )
    return per_crop.groupBy(*keys).agg(F.sum("_area").alias("total_area"))


def coverage_ratio(df: DataFrame, crop_area: str, cropland_area: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles of crop area over cropland area."""
    ratio = df.select(safe_divide(F.col(crop_area), F.col(cropland_area)).alias("ratio"))
    return exact_quantiles(ratio, "ratio", probs)


def dominant_crop(crop_area: DataFrame, area: str = "area_ha", keys: Sequence[str] = CELL, crop: str = "crop") -> DataFrame:
    """Largest crop per cell, the first code on ties, with its share; cells without area drop out."""
    positive = crop_area.where(F.col(area) > 0)
    best = F.min(F.struct((-F.col(area)).alias("a"), F.col(crop).alias("crop")))
    return positive.groupBy(*keys).agg(best.alias("m"), F.sum(area).alias("total")).select(
        *keys, F.col("m.crop").alias("dominant"), (-F.col("m.a") / F.col("total")).alias("dominant_share")
    )


def dominance_counts(dominant: DataFrame) -> DataFrame:
    counts = dominant.groupBy("dominant").agg(F.count(F.lit(1)).alias("n_cells"))
    return counts.withColumn("share", F.col("n_cells") / dominant.agg(F.count(F.lit(1))).scalar())


def harmonize(layers: DataFrame, how: str, value: str = "value", group: str = "crop", keys: Sequence[str] = CELL) -> DataFrame:
    """Several source layers of one target to one: mean or maximum of the valid ones."""
    x = F.when(is_finite(F.col(value)), F.col(value))
    fn = {"mean": F.avg, "max": F.max}[how]
    return layers.groupBy(*keys, group).agg(fn(x).alias(value))
