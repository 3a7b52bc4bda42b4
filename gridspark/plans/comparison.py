"""Old against new models on identical cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.joins import checked_join, region_join
from gridspark.operators.metrics import improved_share, models_long, regression_metrics, weighted_mean
from gridspark.operators.scan import exact_quantiles


def paired(old: DataFrame, new: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Both predictions per cell; fails unless cells are unique and observations agree."""
    a = old.withColumnRenamed(p, "p_old")
    b = new.select(*keys, F.col(p).alias("p_new"), F.col(y).alias("_y"))
    joined = checked_join(a, b, keys, "1:1")
    clash = joined.where(F.abs(F.col(y) - F.col("_y")) > 1e-6).limit(1).collect()
    if clash:
        raise ValueError(f"observations differ: {clash[0].asDict()}")
    return joined.drop("_y")


def model_change(pairs: DataFrame, y: str = "y") -> DataFrame:
    """Residuals of both models, gain in absolute error and change of the prediction per cell."""
    o, old, new = F.col(y), F.col("p_old"), F.col("p_new")
    return pairs.withColumns({
        "residual_old": old - o, "residual_new": new - o,
        "abs_error_improvement": F.abs(old - o) - F.abs(new - o), "prediction_change": new - old,
    })


def regional_change(pairs: DataFrame, regions: DataFrame, w: str, y: str = "y") -> DataFrame:
    """Old and new fit per region, with and without weights, and the share of cells improved."""
    inside = region_join(pairs, regions)
    weightings = F.array(
        F.struct(F.lit("unweighted").alias("weighting"), F.lit(1.0).alias("_w")), F.struct(F.lit("weighted").alias("weighting"), F.col(w).alias("_w"))
    )
    rows = inside.withColumn("_k", F.explode(weightings)).select(*[c for c in inside.columns if c != w], "_k.weighting", "_k._w")
    by = ["region", "weighting"]
    # Both models in one pass; the second grouping has two rows per region and weighting.
    fits = regression_metrics(models_long(rows, {"old": "p_old", "new": "p_new"}, [*by, y, "_w"]), y, "p", "_w", [*by, "model"])
    wide = fits.groupBy(*by).agg(*[F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{c}_{m}") for m in ("old", "new") for c in ("rmse", "mae", "r2")])
    extra = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"), improved_share(F.col("p_old"), F.col("p_new"), F.col(y), F.col("_w")).alias("improved_pct"),
        weighted_mean(F.abs(F.col("p_new") - F.col("p_old")), F.col("_w")).alias("mean_abs_change"),
    )
    out = wide.join(extra, by)
    return out.withColumn("rmse_change_pct", F.when(F.col("rmse_old") > 0, (F.col("rmse_new") / F.col("rmse_old") - 1.0) * 100.0))


def before_after(pairs: DataFrame, w: str, y: str = "y") -> DataFrame:
    """Metrics of both models on the same cells and their differences."""
    long = models_long(pairs, {"before": "p_old", "after": "p_new"}, [y, w])
    m = regression_metrics(long, y, "p", w, ["model"])
    side = lambda s, c: F.max(F.when(F.col("model") == s, F.col(c)))
    cols = [F.max("n_cells").alias("n_cells")]
    for c in ("rmse", "mae", "r2", "bias_predicted_minus_observed"):
        cols += [side("before", c).alias(f"{c}_before"), side("after", c).alias(f"{c}_after"), (side("after", c) - side("before", c)).alias(f"{c}_delta")]
    return m.agg(*cols)


def oof_diagnostics(oof: DataFrame, y: str, p: str, block: str) -> DataFrame:
    """Metrics per block with the colour caps shared by all of them."""
    errors = oof.select(F.abs(F.col(p) - F.col(y)).alias("ae"), ((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("se"))
    caps = {"ae_cap": exact_quantiles(errors, "ae", {"q": 0.995}).scalar(), "se_cap": exact_quantiles(errors, "se", {"q": 0.99}).scalar()}
    return regression_metrics(oof, y, p, by=[block]).withColumns(caps)
