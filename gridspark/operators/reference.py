"""Prices, calories and country summaries."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.scalar import safe_divide
from gridspark.operators.scan import exact_quantiles
from gridspark.operators.temporal import recent_window

# Names of the price and food-balance series.
PRICE_ELEMENT = "Producer Price (USD/tonne)"
ANNUAL = "Annual value"
QUANTITY = "Food supply quantity (kg/capita/yr)"
ENERGY = "Food supply (kcal/capita/day)"


def price_summary(prices: DataFrame, years: int = 5) -> DataFrame:
    """Producer price per item over the last ``years`` years."""
    valid = prices.where(
        (F.col("element") == PRICE_ELEMENT) & (F.col("months") == ANNUAL) & F.col("yr").isNotNull() & (F.col("val") > 0)
    )
    recent = recent_window(valid, "yr", years)
    base = recent.groupBy("item").agg(
        F.avg("val").alias("price_mean"),
        F.count("val").alias("observations"),
        F.count_distinct("area").alias("countries"),
        F.min("yr").alias("min_year"),
        F.max("yr").alias("max_year"),
    )
    return base.join(exact_quantiles(recent, "val", {"price_median": 0.5}, ["item"]), "item")


def calorie_summary(fbs: DataFrame, years: int = 5, world: str = "World") -> DataFrame:
    """kcal per kg and item: the world rows if there are any, else every area."""
    has_world = fbs.where(F.col("area") == world).select(F.lit(True).alias("x")).limit(1)
    chosen = fbs.where(
        F.col("element").isin(QUANTITY, ENERGY) & ((F.col("area") == world) | ~has_world.exists())
    )
    recent = recent_window(chosen, "yr", years)
    wide = recent.groupBy("area", "item", "yr").pivot("element", [QUANTITY, ENERGY]).agg(F.avg("val"))
    kcal = F.col(f"`{ENERGY}`") * 365.0 / F.col(f"`{QUANTITY}`")
    per_kg = wide.where(F.col(f"`{QUANTITY}`") > 0).select("item", "yr", kcal.alias("kcal"))
    valid = per_kg.where((F.col("kcal") > 0) & (F.col("kcal") < 10000))
    base = valid.groupBy("item").agg(
        F.avg("kcal").alias("kcal_mean"), F.count("kcal").alias("observations"), F.min("yr").alias("min_year"),
        F.max("yr").alias("max_year"),
    )
    return base.join(exact_quantiles(valid, "kcal", {"kcal_median": 0.5}, ["item"]), "item")


def zone_summary(cells: DataFrame, zone: str, area: str, yield_kg_ha: str, share: str) -> DataFrame:
    """Area, production and area-weighted yield per zone, in full and on the cropped share of each cell."""
    a, y, s = F.col(area), F.col(yield_kg_ha), F.coalesce(F.col(share), F.lit(0.0))
    valid = cells.where((a > 0) & (y > 0))
    sums = valid.groupBy(zone).agg(
        F.sum(a).alias("area_ha"),
        F.sum(a * y / 1000.0).alias("production_t"),
        F.sum(a * s).alias("cropped_area_ha"),
        F.sum(a * s * y / 1000.0).alias("cropped_production_t"),
        F.count(F.lit(1)).alias("n_cells"),
    )
    return sums.withColumns({
        "mean_yield_kg_ha": safe_divide(F.col("production_t") * 1000.0, F.col("area_ha")),
        "cropped_mean_yield_kg_ha": safe_divide(F.col("cropped_production_t") * 1000.0, F.col("cropped_area_ha")),
    })


def stage_reduction(stages: DataFrame, zone: str, climate: str, attainable: str, adjusted: str) -> DataFrame:
    """Production left after each stage per zone and in total, as shares and percentage losses."""
    total = stages.agg(*[F.sum(c).alias(c) for c in (climate, attainable, adjusted)]).select(
        F.lit("TOTAL").alias(zone), climate, attainable, adjusted
    )
    both = stages.select(F.col(zone).cast("string").alias(zone), climate, attainable, adjusted).unionByName(total)
    a, b, c = F.col(climate), F.col(attainable), F.col(adjusted)
    return both.withColumns({
        "attainable_share": safe_divide(b, a),
        "adjusted_share_of_attainable": safe_divide(c, b),
        "adjusted_share": safe_divide(c, a),
        "climate_loss_pct": safe_divide((a - b) * 100.0, a),
        "cropland_loss_pct": safe_divide((b - c) * 100.0, b),
        "total_loss_pct": safe_divide((a - c) * 100.0, a),
    })


def potential_vs_actual(zones: DataFrame, actual: DataFrame, zone: str, potential: str, observed: str,
                        region: str | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """Actual over potential production with log10 columns; some zones may be moved to another region."""
    joined = zones.join(actual, zone).where((F.col(potential) > 0) & (F.col(observed) > 0))
    if region is not None:
        label = F.col(region)
        for name, target in (overrides or {}).items():
            label = F.when(F.col(zone) == name, target).otherwise(label)
        joined = joined.withColumn(region, label)
    return joined.withColumns({
        "ratio": F.col(observed) / F.col(potential),
        "log10_potential": F.log10(potential),
        "log10_actual": F.log10(observed),
    })
