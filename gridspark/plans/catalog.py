"""Fixed catalogues: the checked crop mapping and audits of a feature catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.metrics import spearman_matrix
from gridspark.operators.ranking import set_checks
from gridspark.operators.summary import variable_summary

# Climate crop code -> (price item, food-balance item).
CHECKED_MAPPING = {
    "WHEA": ("Wheat", "Wheat and products"),
    "HWHE": ("Wheat", "Wheat and products"),
    "SWHE": ("Wheat", "Wheat and products"),
    "TWHE": ("Wheat", "Wheat and products"),
    "MAIZ": ("Maize (corn)", "Maize and products"),
    "HMZE": ("Maize (corn)", "Maize and products"),
    "LMZE": ("Maize (corn)", "Maize and products"),
    "TMZE": ("Maize (corn)", "Maize and products"),
    "MZSI": ("Maize (corn)", "Maize and products"),
    "RICW": ("Rice", "Rice and products"),
    "RICD": ("Rice", "Rice and products"),
    "BARL": ("Barley", "Barley and products"),
    "HBRL": ("Barley", "Barley and products"),
    "SBRL": ("Barley", "Barley and products"),
    "TBRL": ("Barley", "Barley and products"),
    "SORG": ("Sorghum", "Sorghum and products"),
    "BSRG": ("Sorghum", "Sorghum and products"),
    "HSRG": ("Sorghum", "Sorghum and products"),
    "LSRG": ("Sorghum", "Sorghum and products"),
    "TSRG": ("Sorghum", "Sorghum and products"),
    "MLLT": ("Millet", "Millet and products"),
    "FIMLT": ("Millet", "Millet and products"),
    "FMLT": ("Millet", "Millet and products"),
    "PMLT": ("Millet", "Millet and products"),
    "SOYB": ("Soya beans", "Soyabeans"),
    "RAPE": ("Rape or colza seed", "Rape and Mustardseed"),
    "SRAP": ("Rape or colza seed", "Rape and Mustardseed"),
    "WRAP": ("Rape or colza seed", "Rape and Mustardseed"),
    "SUNF": ("Sunflower seed", "Sunflower seed"),
    "GRND": ("Groundnuts, excluding shelled", "Groundnuts"),
    "BEAN": ("Beans, dry", "Beans"),
    "WPOT": ("Potatoes", "Potatoes and products"),
    "SPOT": ("Sweet potatoes", "Sweet potatoes"),
    "CASV": ("Cassava, fresh", "Cassava and products"),
    "SUGB": ("Sugar beet", "Sugar beet"),
    "SUGC": ("Sugar cane", "Sugar cane"),
}


def catalog_audit(catalog: DataFrame, sample: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every catalogue or sample feature with its status and, where present, its summary."""
    spark = sample.sparkSession
    actual = spark.createDataFrame([(c,) for c in features], "feature string")
    status = set_checks(catalog, actual, "feature")
    return status.join(variable_summary(sample, features), "feature", "left").join(
        catalog.select("feature", F.col("kind")), "feature", "left"
    )


def catalog_order(catalog: DataFrame, features: Sequence[str], position: str = "position") -> DataFrame:
    """position, expected, actual, in_order: the catalogue's features beside those of the source model, place by place.

    Places are counted from 0 in the catalogue's order; a side that is shorter has nulls, which are out of order.
    """
    spark = catalog.sparkSession
    wanted = catalog.select((F.row_number().over(Window.orderBy(position, "feature")) - 1).alias("position"), F.col("feature").alias("expected"))
    actual = spark.createDataFrame(list(enumerate(features)), "position int, actual string")
    return wanted.join(actual, "position", "full").withColumn("in_order", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def catalog_correlation(catalog: DataFrame, sample: DataFrame, kind: str = "kind") -> DataFrame:
    """a, b, spearman of the catalogue's features that the sample has, but for categorical ones."""
    wanted = [r["feature"] for r in catalog.where(F.col(kind) != "categorical").select("feature").distinct().orderBy("feature").collect()]
    return spearman_matrix(sample, [f for f in wanted if f in sample.columns])
