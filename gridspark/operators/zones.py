"""Zones (polygons) burnt onto the grid by scan lines, and zone lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.grid import GridSpec


def edges(vertices: DataFrame, zone: str = "zone", ring: str = "ring", seq: str = "seq") -> DataFrame:
    """Closed rings of (lon, lat) vertices as edges."""
    nxt = Window.partitionBy(zone, ring).orderBy(seq)
    first = F.first_value(F.struct("lon", "lat")).over(nxt)
    following = F.coalesce(F.lead(F.struct("lon", "lat")).over(nxt), first)
    return vertices.select(
        zone, ring, F.col("lon").alias("x1"), F.col("lat").alias("y1"), following["lon"].alias("x2"), following["lat"].alias("y2")
    )


def rasterize_zones(edge_table: DataFrame, spec: GridSpec, zone: str = "zone") -> DataFrame:
    """Cells whose centre lies in each zone (even-odd rule), one row per (zone, r, c).

    Each edge is cut by the row centre lines it crosses; sorted crossings pair
    into column runs. Only edges are shuffled, never cell-edge pairs.
    """
    step = spec.lat_step
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(F.floor((F.lit(90.0) - high) / step - 0.5), F.lit(0).cast("long"))
    last = F.least(F.ceil((F.lit(90.0) - low) / step - 0.5), F.lit(spec.n_rows - 1).cast("long"))
    cut = (
        edge_table.where((F.col("y1") != F.col("y2")))
        .withColumn("r", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
        .withColumn("_y", spec.lat(F.col("r")))
        .where((low <= F.col("_y")) & (F.col("_y") < high))
        .withColumn("_x", F.col("x1") + (F.col("_y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    )
    w = Window.partitionBy(zone, "r").orderBy("_x")
    runs = (
        cut.withColumn("_k", F.row_number().over(w))
        .withColumn("_end", F.lead("_x").over(w))
        .where((F.col("_k") % 2 == 1) & F.col("_end").isNotNull())
    )
    # Centres in [start, end): column c has its centre at -180 + (c + 0.5) * step.
    start = F.greatest(F.ceil((F.col("_x") + 180.0) / spec.lon_step - 0.5), F.lit(0).cast("long"))
    end = F.least(F.ceil((F.col("_end") + 180.0) / spec.lon_step - 0.5) - 1, F.lit(spec.n_cols - 1).cast("long"))
    return runs.select(zone, "r", start.alias("_c0"), end.alias("_c1")).where("_c0 <= _c1").select(
        zone, "r", F.explode(F.sequence("_c0", "_c1")).alias("c")
    )


def zone_of(cells: DataFrame, zone_cells: DataFrame, zone: str = "zone") -> DataFrame:
    """Label each cell with its zone; the lowest label wins where zones overlap."""
    label = zone_cells.groupBy("r", "c").agg(F.min(zone).alias(zone))
    return cells.join(label, ["r", "c"], "left")
