"""Summaries of local attributions (long tables of cell, feature, phi)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators.metrics import spearman, weighted_corr, weighted_mean
from gridspark.operators.ranking import quantile_bins, share_within
from gridspark.operators.scan import exact_quantiles, weighted_quantiles
from gridspark.session import cut_lineage

# Fixed value: share of the total below which no factor counts as dominant.
DOMINANT_SHARE = 0.45


def attribution_summary(phi: DataFrame, by: Sequence[str], feature: str = "feature", w: str = "w") -> DataFrame:
    """Additive sums and mean absolute / signed attribution, with and without weights."""
    p, wc = F.col("phi"), F.col(w)
    sums = phi.groupBy(*by, feature).agg(
        F.count("phi").alias("n"), F.sum(wc).alias("sum_weight"), F.sum(wc * F.abs(p)).alias("sum_abs_weighted"),
        F.sum(wc * p).alias("sum_signed_weighted"), F.avg(F.abs(p)).alias("mean_abs"), F.avg(p).alias("mean_signed"),
    ).withColumns({
        "mean_abs_weighted": F.col("sum_abs_weighted") / F.col("sum_weight"),
        "mean_signed_weighted": F.col("sum_signed_weighted") / F.col("sum_weight"),
    })
    if by:
        return share_within(sums, "mean_abs_weighted", by)
    return sums.withColumn("share", F.col("mean_abs_weighted") / sums.agg(F.sum("mean_abs_weighted")).scalar())


def group_sum_of_abs(phi: DataFrame, group: Column, by: Sequence[str] = (), feature: str = "feature", w: str = "w") -> DataFrame:
    """Sum over the group's features of their mean absolute attribution."""
    per = phi.withColumn("feature_group", group).groupBy(*by, "feature_group", feature).agg(
        weighted_mean(F.abs(F.col("phi")), F.col(w)).alias("_m")
    )
    return per.groupBy(*by, "feature_group").agg(F.sum("_m").alias("old_sum_mean_abs"), F.count(F.lit(1)).alias("n_features"))


def group_totals(phi: DataFrame, group: Column, cell: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Attribution of each group in each cell."""
    return phi.withColumn("feature_group", group).groupBy(*cell, "feature_group").agg(
        F.sum("phi").alias("phi"), *[F.max(k).alias(k) for k in keep]
    )


def group_abs_of_sum(phi: DataFrame, group: Column, cell: Sequence[str] = ("id",), by: Sequence[str] = (),
                     feature: str = "feature", w: str = "w") -> DataFrame:
    """Mean absolute attribution of each group as a whole, and how much its members cancel."""
    whole = group_totals(phi, group, [*by, *cell], [w]).groupBy(*by, "feature_group").agg(
        weighted_mean(F.abs(F.col("phi")), F.col(w)).alias("corrected_mean_abs"),
        weighted_mean(F.col("phi"), F.col(w)).alias("mean_signed"),
    )
    both = whole.join(group_sum_of_abs(phi, group, by, feature, w), [*by, "feature_group"])
    old, new = F.col("old_sum_mean_abs"), F.col("corrected_mean_abs")
    return both.withColumns({
        "old_to_corrected_ratio": F.when(new > 0, old / new),
        "cancellation_pct": F.when(old > 0, (F.lit(1.0) - new / old) * 100.0),
    })


def additivity_check(phi: DataFrame, predictions: DataFrame, cell: Sequence[str], base: str, pred: str, tol: float) -> DataFrame:
    """Largest gap between baseline plus attributions and the prediction."""
    total = phi.groupBy(*cell).agg(F.sum("phi").alias("_s"))
    gap = F.abs(F.col(base) + F.col("_s") - F.col(pred))
    return predictions.join(total, list(cell)).agg(
        F.count(F.lit(1)).alias("n_cells"), F.max(gap).alias("max_error"), (F.max(gap) <= tol).alias("additive")
    )


def class_attribution(phi: DataFrame, by: Sequence[str], w: str = "w") -> DataFrame:
    return phi.groupBy(*by).agg(
        F.count("phi").alias("n"), weighted_mean(F.abs(F.col("phi")), F.col(w)).alias("mean_abs"),
        weighted_mean(F.col("phi"), F.col(w)).alias("mean_signed"),
    )


def dominant_factor(phi_group: DataFrame, cell: Sequence[str], min_share: float = DOMINANT_SHARE) -> DataFrame:
    """The group with the largest absolute attribution per cell, its direction, or ``Mixed``."""
    a = F.abs(F.col("phi"))
    top = F.max(F.struct(a.alias("a"), F.col("feature_group").alias("g"), F.col("phi").alias("phi")))
    per = phi_group.groupBy(*cell).agg(top.alias("t"), F.sum(a).alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("t.a") / F.col("_total"))
    return per.select(
        *cell, F.col("t.g").alias("strongest"), F.col("t.phi").alias("strongest_phi"), share.alias("dominance_share"),
        F.when(share >= min_share, F.col("t.g")).otherwise("Mixed").alias("dominant"),
        F.when(share < min_share, "mixed").when(F.col("t.phi") > 0, "positive").when(F.col("t.phi") < 0, "negative").otherwise("zero").alias("direction"),
    )


def dependence_curve(phi: DataFrame, feature: str = "feature", x: str = "x", n_bins: int = 20, min_n: int = 1, w: str = "w") -> DataFrame:
    """Weighted mean x and attribution per quantile bin of each feature."""
    binned = quantile_bins(phi.where(F.col(w) > 0), x, n_bins, [feature])
    return binned.groupBy(feature, "bin").agg(
        F.count(F.lit(1)).alias("n"), weighted_mean(F.col(x), F.col(w)).alias("x"), weighted_mean(F.col("phi"), F.col(w)).alias("phi")
    ).where(F.col("n") >= min_n)


def category_curve(phi: DataFrame, category: str, min_n: int = 20, w: str = "w") -> DataFrame:
    return class_attribution(phi, [category], w).where(F.col("n") >= min_n)


def value_attribution_relation(phi: DataFrame, feature: str = "feature", x: str = "x") -> DataFrame:
    """How the attribution of each feature follows its value.

    Equal rows are counted in one pass; correlations, quantiles and ranks come from the counts.
    """
    counted = cut_lineage(phi.where(F.col(feature).isNotNull()).groupBy(feature, x, "phi").agg(F.count(F.lit(1)).alias("_n")))
    n, p = F.col("_n"), F.col("phi")
    both = F.when(F.col(x).isNotNull() & p.isNotNull(), n)
    # Features are few, so their means are a map in one row; values enter the sums as distances from them.
    mean = lambda c: F.sum(both * F.col(c)) / F.sum(both)
    means = counted.groupBy(feature).agg(F.struct(mean(x).alias("x"), mean("phi").alias("p")).alias("m"))
    centre = F.try_element_at(means.agg(F.map_from_entries(F.collect_list(F.struct(feature, "m")))).scalar(), F.col(feature))
    base = counted.withColumns({"_cx": F.col(x) - centre["x"], "_cp": p - centre["p"]}).groupBy(feature).agg(
        weighted_corr(F.col("_cx"), F.col("_cp"), both).alias("pearson"),
        (F.sum(F.when(p > 0, n).when(p.isNotNull(), F.lit(0))) / F.sum(F.when(p.isNotNull(), n))).alias("share_positive"), F.sum(n).alias("n"),
    )
    spread = exact_quantiles(counted, "phi", {"p05": 0.05, "p50": 0.5, "p95": 0.95}, [feature], count="_n")
    return base.join(spread, feature).join(spearman(counted, x, "phi", [feature], "_n"), feature)


def robust_limit(phi: DataFrame, feature: str = "feature", w: str = "w", q: float = 0.99) -> DataFrame:
    """Weighted quantile of the absolute attribution per feature and one common rounded limit."""
    limits = weighted_quantiles(phi.withColumn("_a", F.abs("phi")), "_a", w, {"limit": q}, [feature])
    common = limits.agg(F.ceil(F.round(F.max("limit") * 100.0, 6)) / 100.0).scalar()
    return limits.withColumn("common_limit", common)


def attribution_archive(phi: DataFrame, cells: DataFrame, group: Column, groups: Sequence[str], cell: Sequence[str] = ("id",)) -> DataFrame:
    """One row per cell: ids, one column per group, the dominant factor."""
    totals = group_totals(phi, group, cell)
    wide = totals.groupBy(*cell).agg(
        *[F.sum(F.when(F.col("feature_group") == g, F.col("phi"))).alias(f"phi_group__{g}") for g in groups]
    )
    return cells.join(wide, list(cell)).join(dominant_factor(totals, cell), list(cell))


def signed_counts(dominant: DataFrame) -> DataFrame:
    """Cells per dominant factor and direction."""
    counts = dominant.groupBy("dominant", "direction").agg(F.count(F.lit(1)).alias("n_cells"))
    return counts.withColumn("share", F.col("n_cells") / dominant.agg(F.count(F.lit(1))).scalar())
