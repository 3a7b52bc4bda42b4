"""Text expressions for crop names, file names and catalog descriptions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Synonym pairs applied in this order, each seeing the output of the last.
CROP_SYNONYMS = {
    "wetland rice": "rice paddy",
    "dryland rice": "rice paddy",
    "rice wetland": "rice paddy",
    "rice dryland": "rice paddy",
    "maize": "maize corn",
    "soybean": "soybeans",
    "soy bean": "soybeans",
    "white potato": "potatoes",
    "sweet potato": "sweet potatoes",
    "rapeseed": "rape mustard seed",
    "rape": "rape mustard seed",
    "groundnut": "groundnuts",
    "pearl millet": "millet",
    "proso millet": "millet",
    "finger millet": "millet",
    "beans": "beans dry",
    "bean": "beans dry",
    "sunflower": "sunflower seed",
}

# Model features and the concept group each belongs to.
FEATURE_GROUPS = {
    "terrain_constraints": ("elevation_m", "slope", "exclusion_class"),
    "population_labor": ("log_pop_density_2024",),
    "market_access": ("log_city_time_20k_min", "log_port_time_any_min"),
    "water_resources": ("log_glofas_p10_2020", "log_distance_river_gt10_2020"),
    "rainfed_potential": ("log_rainfed_value_top5", "log_rainfed_calorie_top5"),
    "irrigation_potential": ("log_irrigation_value_gain_top5", "log_irrigation_calorie_gain_top5"),
}


def normalize_text(text: Column, synonyms: Mapping[str, str] = CROP_SYNONYMS) -> Column:
    """Lower-case words without brackets or punctuation, with synonyms unified."""
    out = F.regexp_replace(F.lower(text), r"\([^)]*\)", " ")
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")
    for old, new in synonyms.items():
        if old != new:
            out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def feature_group(feature: Column, groups: Mapping[str, Sequence[str]] = FEATURE_GROUPS) -> Column:
    """Concept group of a feature; a ``wx_<n>km_`` prefix belongs to its base feature."""
    base = F.regexp_replace(feature, "^wx_.*?km_", "")
    out = F.lit("other")
    for name, members in reversed(list(groups.items())):
        out = F.when(base.isin(*members), F.lit(name)).otherwise(out)
    return out


def parse_filename(path: Column, pattern: str = r"_A_([A-Z0-9]+)_([AIR])\b") -> tuple[Column, Column]:
    """Crop code and production system from a raster file name."""
    return F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)


def recharge_kind(text: Column) -> Column:
    """Kind of groundwater recharge named in a catalog description, NULL if none."""
    t = F.regexp_replace(F.lower(text), "[_-]", " ")
    # Phrases and variable codes of the recharge products.
    return (
        F.when(t.rlike("diffuse groundwater recharge|qrdif"), "diffuse")
        .when(t.rlike("groundwater recharge from surface water bodies|qrswb|surface water body"), "surface_water_body")
        .when(t.rlike(r"total groundwater recharge|\bqr\b"), "total")
    )
