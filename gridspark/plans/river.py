"""Daily river discharge to distance-to-reliable-river layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.grid import GridSpec
from gridspark.operators.joins import threshold_mask
from gridspark.operators.neighbor import distance_to_mask
from gridspark.operators.regrid import regrid
from gridspark.operators.temporal import annual_percentile, period_mean
from gridspark.session import cut_lineage

# Discharge thresholds in m3/s.
THRESHOLDS = (0.1, 1.0, 10.0)


def reliable_discharge(daily: DataFrame, src: GridSpec, dst: GridSpec) -> DataFrame:
    """Low flow (annual 10th percentile, mean of the years) of the largest river in each target cell."""
    period = period_mean(annual_percentile(daily)).select(F.col("r").alias("fr"), F.col("c").alias("fc"), "p")
    return regrid(period, src, dst, "max", "p").withColumnRenamed("p", "p10")


def river_reliability(daily: DataFrame, src: GridSpec, dst: GridSpec, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Per threshold and cell: low flow and distance to the nearest cell above the threshold."""
    # The layer is small next to the daily series and is read twice below.
    flow = cut_lineage(reliable_discharge(daily, src, dst))
    masks = threshold_mask(flow, "p10", thresholds).where("reliable = 1").select("label", "r", "c")
    distance = distance_to_mask(masks, dst, by=["label"])
    return distance.join(flow, ["r", "c"], "left").select("label", "r", "c", "p10", "km")
