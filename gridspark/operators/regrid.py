"""Re-gridding as key arithmetic and grouped aggregation.

Overlaps are computed with integers, so a ratio such as 5/3 has no rounding.
Source and target grids span the same extent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.grid import GridSpec
from gridspark.operators.scan import small_quantiles


def block_aggregate(fine: DataFrame, factor: int, value: str, row: str = "fr", col: str = "fc",
                    row_offset: int = 0) -> DataFrame:
    """Mean, minimum, median of exact factor x factor blocks; blocks without a value stay absent."""
    keyed = fine.where(F.col(value).isNotNull()).select(
        (F.expr(f"{row} div {factor}") + row_offset).alias("r"), F.expr(f"{col} div {factor}").alias("c"), value
    )
    base = keyed.groupBy("r", "c").agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.count(value).alias("n"))
    return base.join(small_quantiles(keyed, value, {"median": 0.5}, ["r", "c"]), ["r", "c"])


def _span(index: str, n_src: int, n_dst: int) -> Column:
    """Target indexes a source index overlaps."""
    return F.expr(f"sequence(({index} * {n_dst}L) div {n_src}, (({index} + 1) * {n_dst}L - 1) div {n_src})")


def _overlap(index: str, target: str, n_src: int, n_dst: int) -> Column:
    """Share of the source interval inside the target interval."""
    return F.expr(
        f"(least(({index} + 1) * {n_dst}L, ({target} + 1) * {n_src}L) - greatest({index} * {n_dst}L, {target} * {n_src}L)) / {n_dst}L"
    )


def overlaps(fine: DataFrame, src: GridSpec, dst: GridSpec, row: str = "fr", col: str = "fc") -> DataFrame:
    """One row per overlapping (source, target) pair with the share ``w`` of the source area."""
    return (
        fine.withColumn("r", F.explode(_span(row, src.n_rows, dst.n_rows)))
        .withColumn("c", F.explode(_span(col, src.n_cols, dst.n_cols)))
        .withColumn(
            "w",
            _overlap(row, "r", src.n_rows, dst.n_rows) * _overlap(col, "c", src.n_cols, dst.n_cols),
        )
    )


def regrid(fine: DataFrame, src: GridSpec, dst: GridSpec, how: str, value: str, row: str = "fr", col: str = "fc") -> DataFrame:
    """Bring a layer to another grid: max, sum, average, mode, bilinear or nearest."""
    valid = fine.where(F.col(value).isNotNull()).select(F.col(row).alias("_sr"), F.col(col).alias("_sc"), value)
    if how == "nearest":
        return _nearest(valid, src, dst, value)
    if how == "bilinear":
        return _bilinear(valid, src, dst, value)
    pairs = overlaps(valid, src, dst, "_sr", "_sc")
    v, w = F.col(value), F.col("w")
    if how == "max":
        return pairs.groupBy("r", "c").agg(F.max(v).alias(value))
    if how == "sum":
        return pairs.groupBy("r", "c").agg(F.sum(v * w).alias(value))
    if how == "average":
        return pairs.groupBy("r", "c").agg((F.sum(v * w) / F.sum(w)).alias(value))
    if how == "mode":
        # The class with the largest overlapped area; the lowest class wins ties.
        shares = pairs.groupBy("r", "c", value).agg(F.round(F.sum(w), 9).alias("_area"))
        return shares.groupBy("r", "c").agg(F.max_by(value, F.struct("_area", -v)).alias(value))
    raise ValueError(f"unknown method: {how}")


def _nearest(valid: DataFrame, src: GridSpec, dst: GridSpec, value: str) -> DataFrame:
    """The source cell under each target centre."""
    target = dst.cells(valid.sparkSession).select(
        "r", "c",
        F.expr(f"((2 * r + 1) * {src.n_rows}L) div {2 * dst.n_rows}L").alias("_sr"),
        F.expr(f"((2 * c + 1) * {src.n_cols}L) div {2 * dst.n_cols}L").alias("_sc"),
    )
    return target.join(valid, ["_sr", "_sc"]).select("r", "c", value)


def _bilinear(valid: DataFrame, src: GridSpec, dst: GridSpec, value: str) -> DataFrame:
    """Each source cell spreads to the targets between its neighbours' centres.

    Missing corners simply do not contribute, which renormalises the weights.
    """

    def reach(index: str, n_src: int, n_dst: int) -> Column:
        low = f"greatest(cast(floor(({index} - 0.5D) * {n_dst} / {n_src} - 0.5D) as bigint), 0L)"
        high = f"least(cast(ceil(({index} + 1.5D) * {n_dst} / {n_src} - 0.5D) as bigint), {n_dst - 1}L)"
        return F.expr(f"sequence({low}, {high})")

    def weight(index: str, target: str, n_src: int, n_dst: int) -> Column:
        return F.expr(f"greatest(1D - abs(({target} + 0.5D) * {n_src} / {n_dst} - 0.5D - {index}), 0D)")

    spread = (
        valid.withColumn("r", F.explode(reach("_sr", src.n_rows, dst.n_rows)))
        .withColumn("c", F.explode(reach("_sc", src.n_cols, dst.n_cols)))
        .withColumn("w", weight("_sr", "r", src.n_rows, dst.n_rows) * weight("_sc", "c", src.n_cols, dst.n_cols))
        .where(F.col("w") > 0)
    )
    return spread.groupBy("r", "c").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias(value))


def fraction_corrected_avg(df: DataFrame, value: str, mask: str, scale: float = 1.0, offset: float = 0.0,
                           min_coverage: float = 0.25, cap: float = 1000.0, keys=("r", "c")) -> DataFrame:
    """Block mean divided by the share of the block inside the layer's domain."""
    agg = df.groupBy(*keys).agg(
        (F.avg(value) * F.lit(scale) + F.lit(offset)).alias("_decoded"), F.avg(mask).alias("coverage")
    )
    depth = F.col("_decoded") / F.col("coverage")
    valid = (F.col("coverage") >= min_coverage) & (depth >= 0)
    return agg.select(*keys, "coverage", F.when(valid, F.least(depth, F.lit(cap))).alias(value))


def mosaic_best_coverage(layers: DataFrame, value: str, coverage: str = "coverage", order: str = "source",
                         keys=("r", "c")) -> DataFrame:
    """Per cell the source with the greatest coverage; the first source wins ties."""
    rank = F.struct(F.col(coverage), -F.col(order))
    best = F.max_by(F.struct(value, coverage, order), rank)
    return layers.where(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("m")).select(*keys, "m.*")


def coarsen(df: DataFrame, value: str, bbox: tuple[float, float, float, float], step: float = 1.0,
            categorical: bool = False, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Median (or lowest most frequent class) per coarse cell inside (west, east, south, north)."""
    west, east, south, north = bbox
    keyed = df.where(
        F.col(lat).between(south, north) & F.col(lon).between(west, east) & F.col(value).isNotNull()
    ).select(
        F.floor((F.col(lat) - south) / step).alias("iy"), F.floor((F.col(lon) - west) / step).alias("ix"), value
    )
    if categorical:
        counts = keyed.groupBy("iy", "ix", value).agg(F.count(F.lit(1)).alias("_n"))
        return counts.groupBy("iy", "ix").agg(F.max_by(value, F.struct("_n", -F.col(value))).alias(value))
    return small_quantiles(keyed, value, {"_median": 0.5}, ["iy", "ix"]).withColumnRenamed("_median", value)


def region_grid(df: DataFrame, value: str, spec: GridSpec, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Dense regional grid of cell means; cells without a sample hold NULL."""
    inside = F.col("r").between(*rows) & F.col("c").between(*cols)
    dense = spec.cells(df.sparkSession).where(inside)
    means = df.where(inside).groupBy("r", "c").agg(F.avg(value).alias(value))
    return dense.join(means, ["r", "c"], "left")
