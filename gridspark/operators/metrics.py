"""Weighted model evaluation from one pass of sums."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.scalar import clip, is_finite
from gridspark.operators.scan import BIN, SPLIT_ROWS, exact_quantiles, look_up, running_sums, value_ranks, with_bins

# Share of the raw sum of squares below which a spread is only rounding.
NO_SPREAD = 1e-12


def regression_sums(y: str, p: str, w: str | None = None) -> dict[str, Column]:
    """Additive statistics; partial results may be summed over any partitioning."""
    yc, pc = F.col(y), F.col(p)
    wc = F.lit(1.0) if w is None else F.col(w)
    e = pc - yc
    return {
        "n_cells": F.count(F.lit(1)),
        "sw": F.sum(wc), "sy": F.sum(wc * yc), "sp": F.sum(wc * pc), "syy": F.sum(wc * yc * yc),
        "se": F.sum(wc * e), "see": F.sum(wc * e * e), "sae": F.sum(wc * F.abs(e)),
    }


def from_sums(prefix: Sequence[str] = ()) -> list[Column]:
    """Metrics out of :func:`regression_sums`; bias is given in both sign conventions."""
    c = F.col
    spread = c("syy") - c("sy") * c("sy") / c("sw")
    return [
        *[c(x) for x in prefix], c("n_cells"),
        (c("sy") / c("sw")).alias("observed_mean"), (c("sp") / c("sw")).alias("predicted_mean"),
        (c("se") / c("sw")).alias("bias_predicted_minus_observed"), (-c("se") / c("sw")).alias("bias_observed_minus_predicted"),
        F.sqrt(c("see") / c("sw")).alias("rmse"), (c("sae") / c("sw")).alias("mae"),
        F.when(spread > F.lit(NO_SPREAD) * c("syy"), F.lit(1.0) - c("see") / spread).alias("r2"),
    ]


def regression_metrics(df: DataFrame, y: str, p: str, w: str | None = None, by: Sequence[str] = (), p95: bool = False) -> DataFrame:
    """Bias, RMSE, MAE, R2 (and the 95th percentile of the absolute error) per group."""
    valid = df.where(is_finite(F.col(y)) & is_finite(F.col(p)))
    if w is not None:
        valid = valid.where(F.col(w) > 0)
    sums = [s.alias(n) for n, s in regression_sums(y, p, w).items()]
    out = valid.groupBy(*by).agg(*sums).select(*from_sums(by))
    if not p95:
        return out
    errors = exact_quantiles(valid.withColumn("_ae", F.abs(F.col(p) - F.col(y))), "_ae", {"absolute_error_p95": 0.95}, by)
    if by:
        return out.join(errors, list(by))
    return out.withColumn("absolute_error_p95", errors.scalar())


def models_long(oof: DataFrame, models: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per cell and model; ``models`` maps labels to prediction columns."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("p")) for m, c in models.items()])
    return oof.select(*keep, F.explode(pairs).alias("_m")).select(*keep, "_m.model", "_m.p")


def metric_deltas(metrics: DataFrame, baseline: str, by: Sequence[str] = ()) -> DataFrame:
    """Improvement of every model over the baseline row of its group."""
    # The baseline is looked up in the same rows, not in metrics computed again, whose sums may differ in the last digits.
    names = {"_rmse": "rmse", "_mae": "mae", "_r2": "r2"}
    base = F.max(F.when(F.col("model") == baseline, F.struct(*[F.col(c).alias(n) for n, c in names.items()]))).over(Window.partitionBy(*by))
    known = metrics.dropna(subset=list(by)) if by else metrics
    found = known.withColumn("_base", base)
    joined = (found.where(F.col("_base").isNotNull()) if by else found).withColumns({n: F.col(f"_base.{n}") for n in names}).drop("_base")
    gain = F.col("_rmse") - F.col("rmse")
    return joined.withColumns({
        "rmse_improvement_vs_baseline": gain,
        "rmse_improvement_pct": F.when(F.col("_rmse") > 0, gain / F.col("_rmse") * 100.0),
        "mae_improvement_vs_baseline": F.col("_mae") - F.col("mae"),
        "r2_gain_vs_baseline": F.col("r2") - F.col("_r2"),
        "rmse_improved": gain > 0,
    }).drop("_rmse", "_mae", "_r2")


def _score_table(df: DataFrame, y: str, score: str, w: str | None, by: Sequence[str]) -> DataFrame:
    weight = F.lit(1.0) if w is None else F.col(w)
    positive = F.when(F.col(y) == 1, weight).otherwise(F.lit(0.0))
    return df.groupBy(*by, score).agg(F.sum(positive).alias("_pos"), F.sum(weight - positive).alias("_neg"))


def roc_auc(df: DataFrame, y: str, score: str, w: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Exact weighted ROC AUC; pairs of equal score count one half."""
    binned = with_bins(_score_table(df, y, score, w, by), score, by)
    table = running_sums(binned, score, {"_cum": "_neg"}, by, totals={"_p": "_pos", "_n": "_neg"}, bucket=F.col(BIN))
    below = F.col("_cum") - F.col("_neg") / 2.0
    won = F.sum(F.col("_pos") * below)
    return table.groupBy(*by).agg(F.when(F.max(F.col("_p") * F.col("_n")) > 0, won / F.max(F.col("_p") * F.col("_n"))).alias("auc"))


def average_precision(df: DataFrame, y: str, score: str, w: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision over distinct scores, highest first."""
    table = _score_table(df, y, score, w, by).withColumn("_order", -F.col(score)).withColumn("_all", F.col("_pos") + F.col("_neg"))
    scanned = running_sums(with_bins(table, "_order", by), "_order", {"_tp": "_pos", "_seen": "_all"}, by, totals={"_p": "_pos"}, bucket=F.col(BIN))
    step = F.when(F.col("_seen") > 0, F.col("_pos") / F.col("_p") * F.col("_tp") / F.col("_seen"))
    return scanned.where(F.col("_p") > 0).groupBy(*by).agg(F.sum(step).alias("average_precision"))


def accuracy_at(df: DataFrame, y: str, score: str, t: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    hit = ((F.col(score) >= t).cast("int") == F.col(y)).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def weighted_mean(x: Column, w: Column) -> Column:
    """Weighted mean over valid rows of positive weight, NULL without any."""
    ok = is_finite(x) & is_finite(w) & (w > 0)
    total = F.sum(F.when(ok, w))
    return F.when(total > 0, F.sum(F.when(ok, w * x)) / total)


def share_metrics(long: DataFrame, y: str = "y", p: str = "p", w: str = "w", cell: Sequence[str] = ("r", "c"), crop: str = "crop",
                  floor: float = 1e-12) -> DataFrame:
    """Compositional fit: cross-entropy, share RMSE, R2 overall and per crop, dominant-crop accuracy."""
    yc, pc, wc = F.col(y), F.col(p), F.col(w)
    # One weight per cell; a cell with k crops has k rows.
    means = long.groupBy(crop).agg(weighted_mean(yc, wc).alias("_mean"))
    centred = long.join(means, crop)
    per_crop = centred.groupBy(crop).agg(
        F.sum(wc * (yc - pc) * (yc - pc)).alias("sse"), F.sum(wc * (yc - F.col("_mean")) * (yc - F.col("_mean"))).alias("sst"),
        F.sum(-wc * yc * F.log(clip(pc, floor, 1.0))).alias("ce"), F.sum(wc).alias("w"),
    ).withColumn("_r2", F.when(F.col("sst") > 0, F.lit(1.0) - F.col("sse") / F.col("sst")))
    overall = per_crop.agg(
        F.sqrt(F.sum("sse") / F.sum("w")).alias("share_rmse"),
        (F.lit(1.0) - F.sum("sse") / F.sum("sst")).alias("r2"),
        F.avg("_r2").alias("crop_r2_mean"),
        F.sum("ce").alias("_ce"),
    )
    median = exact_quantiles(per_crop, "_r2", {"m": 0.5}).scalar()
    cells = long.groupBy(*cell).agg(
        F.min(F.struct((-yc).alias("a"), crop))[crop].alias("truth"), F.min(F.struct((-pc).alias("a"), crop))[crop].alias("guess"),
        F.max(wc).alias("cw"),
    )
    hits = cells.agg(
        (F.sum(F.when(F.col("truth") == F.col("guess"), F.col("cw")).otherwise(0.0)) / F.sum("cw")).alias("acc"), F.sum("cw").alias("tw")
    )
    return overall.select(
        (F.col("_ce") / hits.select("tw").scalar()).alias("cross_entropy"), "share_rmse", "r2", "crop_r2_mean",
        median.alias("crop_r2_median"), hits.select("acc").scalar().alias("dominant_accuracy"),
    )


def global_share_baseline(long: DataFrame, y: str = "y", w: str = "w", crop: str = "crop") -> DataFrame:
    """Weighted mean share of each crop, normalised to sum to one."""
    means = long.groupBy(crop).agg(weighted_mean(F.col(y), F.col(w)).alias("mean_share"))
    return means.withColumn("mean_share", F.col("mean_share") / means.agg(F.sum("mean_share")).scalar())


def improved_share(old: Column, new: Column, y: Column, w: Column) -> Column:
    """Weighted percentage of rows whose absolute error fell."""
    better = (F.abs(new - y) < F.abs(old - y)).cast("double")
    return weighted_mean(better, w) * 100.0


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Rank correlation with average ranks; a row of counted rows stands for ``count`` equal rows."""
    # Rows enter as distinct (x, y) pairs with a count, so copies meet the ranks once.
    valid = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = valid.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_n")) if count is None else valid.select(*by, x, y, F.col(count).alias("_n"))
    ranked = pairs
    for value, name in ((x, "_rx"), (y, "_ry")):
        counts = pairs.groupBy(*by, value).agg(F.sum("_n").alias("_rows"))
        ranked = look_up(ranked, value_ranks(counts, value, "_rows", by, name), [*by, value], "_rows")
    return ranked.groupBy(*by).agg(weighted_corr(F.col("_rx"), F.col("_ry"), F.col("_n")).alias("spearman"))


def weighted_corr(x: Column, y: Column, n: Column) -> Column:
    """Correlation of rows that stand for ``n`` equal rows each."""
    total = F.sum(n)
    sx, sy = F.sum(n * x), F.sum(n * y)
    cov = F.sum(n * x * y) - sx * sy / total
    vx, vy = F.sum(n * x * x) - sx * sx / total, F.sum(n * y * y) - sy * sy / total
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def spearman_matrix(df: DataFrame, cols: Sequence[str], hot_rows: int = SPLIT_ROWS) -> DataFrame:
    """a, b, spearman: rank correlation of every pair of columns over the rows that have all of them.

    Equal rows are counted first. All columns are ranked together as (column, value) counts, ranks go back to the row by its
    hash, and one aggregate holds the products of all pairs.
    """
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]).dropna()
    values = [f"_{i}" for i in range(len(cols))]
    counted = rows.groupBy(*values).agg(F.count(F.lit(1)).alias("_n"))
    row = F.struct(F.xxhash64(*values), F.xxhash64(F.lit(1), *reversed(values)))
    entries = F.array(*[F.struct(F.lit(i).alias("_column"), F.col(v).alias("_value")) for i, v in enumerate(values)])
    long = counted.select(row.alias("_row"), "_n", F.explode(entries).alias("_e")).select("_row", "_n", "_e.*")
    ranks = value_ranks(long.groupBy("_column", "_value").agg(F.sum("_n").alias("_rows")), "_value", "_rows", ["_column"], "_rank")
    found = look_up(long, ranks, ["_column", "_value"], "_rows", hot_rows)
    wide = found.groupBy("_row").agg(F.first("_n").alias("_n"), *[F.max(F.when(F.col("_column") == i, F.col("_rank"))).alias(v) for i, v in enumerate(values)])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    gram = wide.agg(*[weighted_corr(F.col(f"_{i}"), F.col(f"_{j}"), F.col("_n")).alias(f"{i}_{j}") for i, j in pairs])
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{min(i, j)}_{max(i, j)}").alias("spearman")) for i, a in enumerate(cols) for j, b in enumerate(cols)
    ])
    return gram.select(F.explode(cells).alias("e")).select("e.*")


def corr_t(r: Column, n: Column) -> Column:
    """t statistic of a correlation."""
    return F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (F.lit(1.0) - r * r)))


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series eight steps further up."""
    y = x + F.lit(8.0)
    steps = F.lit(0.0)
    for i in range(8):
        steps = steps + F.log(x + F.lit(float(i)))
    # The first terms of Stirling's series.
    series = F.lit(1.0) / (12 * y) - F.lit(1.0) / (360 * F.pow(y, 3)) + F.lit(1.0) / (1260 * F.pow(y, 5)) - F.lit(1.0) / (1680 * F.pow(y, 7))
    return (y - F.lit(0.5)) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - steps


def _beta_fraction(a: Column, b: Column, x: Column, steps: int = 200) -> Column:
    """The continued fraction of the incomplete beta function, by its even and odd convergents' ratios."""
    tiny = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    first = F.lit(1.0) / tiny(F.lit(1.0) - (a + b) * x / (a + 1))

    def advance(s: Column, m: Column) -> Column:
        def half(c: Column, d: Column, h: Column, factor: Column) -> tuple[Column, Column, Column]:
            d = F.lit(1.0) / tiny(F.lit(1.0) + factor * d)
            c = tiny(F.lit(1.0) + factor / c)
            return c, d, h * d * c

        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        c, d, h = half(s["c"], s["d"], s["h"], even)
        c, d, h = half(c, d, h, odd)
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, advance)["h"]


# Degrees of freedom from which the corrected normal limit is used; its error is below 1e-7 there.
NORMAL_FROM = 10_000


def correlation_p(t: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation's t statistic with n - 2 degrees of freedom."""
    df = (n - 2).cast("double")
    x = df / (df + t * t)
    a, b = df / 2, F.lit(0.5)
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - F.lit(0.5 * math.log(math.pi)) + a * F.log(x) + b * F.log(F.lit(1.0) - x))
    direct = front * _beta_fraction(a, b, x) / a
    mirrored = F.lit(1.0) - front * _beta_fraction(b, a, F.lit(1.0) - x) / b
    exact = F.when(t == 0, 1.0).when(x < (a + 1) / (a + b + 2), direct).otherwise(mirrored)
    z = F.abs(t) * (F.lit(1.0) - 1 / (4 * df)) / F.sqrt(F.lit(1.0) + t * t / (2 * df))
    return F.when(df < NORMAL_FROM, exact).otherwise(_normal_tails(z))


def _normal_tails(z: Column) -> Column:
    # Abramowitz and Stegun 26.2.17.
    k = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * z)
    poly = F.lit(0.0)
    for coefficient in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + F.lit(coefficient)) * k
    return F.lit(2.0 / math.sqrt(2 * math.pi)) * poly * F.exp(-z * z / 2)
