"""Grid geometry as Column arithmetic on integer (row, col) keys."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The two Earth radii used for distances (km) and for hectare areas (m).
EARTH_RADIUS_KM = 6371.0088
EARTH_RADIUS_M = 6_371_000.0
KM_PER_DEGREE = EARTH_RADIUS_KM * math.pi / 180.0


@dataclass(frozen=True)
class GridSpec:
    """A north-up global grid; row 0 touches 90 N and column 0 touches 180 W."""

    n_rows: int
    n_cols: int

    @property
    def lat_step(self) -> float:
        return 180.0 / self.n_rows

    @property
    def lon_step(self) -> float:
        return 360.0 / self.n_cols

    def lat(self, row: Column) -> Column:
        return F.lit(90.0) - (row + F.lit(0.5)) * F.lit(self.lat_step)

    def lon(self, col: Column) -> Column:
        return F.lit(-180.0) + (col + F.lit(0.5)) * F.lit(self.lon_step)

    def row_of(self, lat: Column) -> Column:
        return _nearest_index((F.lit(90.0 - self.lat_step / 2) - lat) / F.lit(self.lat_step), self.n_rows)

    def col_of(self, lon: Column) -> Column:
        return _nearest_index((lon - F.lit(-180.0 + self.lon_step / 2)) / F.lit(self.lon_step), self.n_cols)

    def cells(self, spark: SparkSession, row: str = "r", col: str = "c") -> DataFrame:
        """The dense cell table, generated in parallel by ``range``."""
        n = F.lit(self.n_cols).cast("long")
        return spark.range(self.n_rows * self.n_cols).select(
            F.expr(f"id div {self.n_cols}").cast("long").alias(row), (F.col("id") % n).alias(col)
        )

    def area(self, row: Column, radius: float = EARTH_RADIUS_KM) -> Column:
        """Exact spherical area of a cell, in the square of the radius' unit."""
        north = F.radians(F.lit(90.0) - row * F.lit(self.lat_step))
        south = F.radians(F.lit(90.0) - (row + F.lit(1)) * F.lit(self.lat_step))
        return F.lit(radius**2 * math.radians(self.lon_step)) * (F.sin(north) - F.sin(south))

    def box_half_height(self, radius_km: float) -> int:
        return max(1, math.ceil(radius_km / (KM_PER_DEGREE * self.lat_step)))

    def box_half_width(self, row: Column, radius_km: float) -> Column:
        """Columns on each side that cover ``radius_km`` at the latitude of ``row``."""
        cos_lat = F.greatest(F.cos(F.radians(self.lat(row))), F.lit(1e-6))
        half = F.ceil(F.lit(radius_km / (KM_PER_DEGREE * self.lon_step)) / cos_lat)
        return F.least(half, F.lit(self.n_cols // 2 - 1).cast("long"))


# Fixed value: the 5-arc-minute grid all global layers are brought to.
FIVE_MINUTES = GridSpec(2160, 4320)


def _nearest_index(position: Column, n: int) -> Column:
    return F.least(F.greatest(F.rint(position), F.lit(0.0)), F.lit(float(n - 1))).cast("long")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / F.lit(2.0))
    half_lon = F.sin(F.radians(lon2 - lon1) / F.lit(2.0))
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def normalize_lon(lon: Column) -> Column:
    """Wrap any longitude into [-180, 180)."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def spatial_block(lat: Column, lon: Column, degrees: float = 10.0) -> Column:
    """Identifier of the square block of ``degrees`` that holds a point."""
    per_row = int(round(360.0 / degrees))
    return (
        F.floor((lat + F.lit(90.0)) / F.lit(degrees)) * F.lit(per_row)
        + F.floor((lon + F.lit(180.0)) / F.lit(degrees))
    ).cast("long")


def flip_rows(row: Column, spec: GridSpec) -> Column:
    """Row key of a south-up layer expressed north-up."""
    return F.lit(spec.n_rows - 1) - row
