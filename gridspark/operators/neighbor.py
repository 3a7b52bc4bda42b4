"""Neighbourhood sums, distance to a mask, nearest neighbours, spatial autocorrelation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.grid import EARTH_RADIUS_KM, GridSpec, haversine_km
from gridspark.functions.scalar import clip, is_finite, safe_divide
from gridspark.operators.scan import exact_quantiles
from gridspark.operators.sphere_tree import knn_on_sphere
from gridspark.session import cut_lineage


# --- latitude-aware boxes -------------------------------------------------------------------


# Box sums are exact: running sums of doubles would drift and miss a threshold by one bit.
EXACT = "decimal(38,15)"


def _event(at: Column, sign: int) -> Column:
    return F.struct(at.cast("long").alias("at"), F.lit(sign).alias("sign"))


def _sweep(events: DataFrame, lane: str, axis: str, sums: Sequence[str], n: int) -> DataFrame:
    """Turn +/- events at positions of ``axis`` into running sums along each lane."""
    merged = events.where(F.col("at").between(0, n - 1)).groupBy(lane, F.col("at").alias(axis)).agg(
        *[F.sum(F.when(F.col("sign") > 0, F.col(s)).when(F.col("sign") < 0, -F.col(s))).alias(s) for s in sums]
    )
    w = Window.partitionBy(lane).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    return merged.select(lane, axis, *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(s) for s in sums])


def box_totals(layer: DataFrame, spec: GridSpec, radius_km: float, value: str, edge: str) -> DataFrame:
    """Sum ``s``, valid count ``n`` and nominal cell count ``width`` of the box around every cell.

    A cell adds its value where its reach begins and takes it away where it
    ends, so a box of any width costs two events and one running sum per axis.
    A lane is one grid row or column: at most ``n_cols`` or ``n_rows`` positions.
    Sums are decimals with 15 places, so values keep 23 digits before the point and their order does not matter.
    Longitude wraps; rows beyond the poles repeat the edge row (``edge="repeat"``)
    or count as zero (``edge="zero"``).
    """
    n_rows, n_cols = spec.n_rows, spec.n_cols
    zero = F.array(F.struct(F.col("c").alias("at"), F.lit(0).alias("sign")))
    dense = spec.cells(layer.sparkSession).select(
        "r", F.lit(0).cast(EXACT).alias("s"), F.lit(0).cast("long").alias("n"), F.explode(zero).alias("e")
    )
    x = F.col(value)
    half = spec.box_half_width(F.col("r"), radius_km)
    start, stop = F.col("c") - half, F.col("c") + half + 1
    # A reach that leaves the map on one side enters it again on the other.
    events = F.array(
        _event(F.pmod(start, F.lit(n_cols)), 1),
        _event(F.when(stop > n_cols, stop - n_cols).otherwise(stop), -1),
        _event(F.when((start < 0) | (stop > n_cols), F.lit(0)).otherwise(F.lit(-1)), 1),
    )
    sources = layer.where(is_finite(x)).select(
        "r", x.cast(EXACT).alias("s"), F.lit(1).cast("long").alias("n"), F.explode(events).alias("e")
    )
    along_rows = _sweep(dense.unionByName(sources).select("r", "s", "n", "e.at", "e.sign"), "r", "c", ["s", "n"], n_cols)

    tall = spec.box_half_height(radius_km)
    copies = F.array(F.col("r"))
    if edge == "repeat":
        above = F.when(F.col("r") == 0, F.sequence(F.lit(-tall), F.lit(-1)))
        below = F.when(F.col("r") == n_rows - 1, F.sequence(F.lit(n_rows), F.lit(n_rows + tall - 1)))
        none = F.array().cast("array<bigint>")
        copies = F.concat(
            copies, F.coalesce(above.cast("array<bigint>"), none), F.coalesce(below.cast("array<bigint>"), none)
        )
    nominal = (F.lit(2) * spec.box_half_width(F.col("r"), radius_km) + F.lit(1)).cast("long")
    spread = along_rows.withColumn("width", nominal).withColumn("_at", F.explode(copies))
    ends = F.array(_event(F.greatest(F.col("_at") - tall, F.lit(0).cast("long")), 1), _event(F.col("_at") + tall + 1, -1))
    fill = spec.cells(layer.sparkSession).select(
        "c", F.lit(0).cast(EXACT).alias("s"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("width"),
        F.col("r").alias("at"), F.lit(0).alias("sign"),
    )
    moved = spread.withColumn("e", F.explode(ends)).select("c", "s", "n", "width", "e.at", "e.sign")
    return _sweep(fill.unionByName(moved), "c", "r", ["s", "n", "width"], n_rows).select("r", "c", "s", "n", "width")


def box_mean_km(layer: DataFrame, spec: GridSpec, radius_km: float, value: str = "value", min_valid: float = 0.25) -> DataFrame:
    """Mean of the valid cells in each box, where at least ``min_valid`` of its cells are valid."""
    t = box_totals(layer, spec, radius_km, value, edge="repeat")
    enough = (F.col("n") > 0) & (F.col("n") >= F.lit(min_valid) * F.col("width"))
    return t.select("r", "c", F.when(enough, F.col("s").cast("double") / F.col("n")).alias("mean"), "n", "width")


def box_sum_km(layer: DataFrame, spec: GridSpec, radius_km: float, value: str = "value") -> DataFrame:
    return _exact_box_sum(layer, spec, radius_km, value, "total").withColumn("total", F.col("total").cast("double"))


def _exact_box_sum(layer: DataFrame, spec: GridSpec, radius_km: float, value: str, name: str) -> DataFrame:
    return box_totals(layer, spec, radius_km, value, edge="zero").select("r", "c", F.col("s").alias(name))


def neighbourhood_share(num: DataFrame, den: DataFrame, spec: GridSpec, radius_km: float, value: str = "value",
                        min_den: float = 5.0) -> DataFrame:
    """Ratio of two box sums, raw and clipped to [0,1], where the denominator is large enough."""
    a = _exact_box_sum(num, spec, radius_km, value, "num")
    b = _exact_box_sum(den, spec, radius_km, value, "den")
    enough = F.col("den") >= F.lit(min_den).cast(EXACT)
    ratio = F.when(enough, safe_divide(F.col("num").cast("double"), F.col("den").cast("double")))
    return a.join(b, ["r", "c"]).select(
        "r", "c", ratio.alias("share_raw"), clip(ratio).alias("share"),
        (F.coalesce(ratio, F.lit(0.0)) > 1.0).alias("above_one"),
    )


# --- distance to a mask ---------------------------------------------------------------------


def _row_pass(spec: GridSpec, wrap: bool):
    """Nearest masked cell for every column of one grid row, from each column's nearest masked rows."""
    n = spec.n_cols
    lat = np.radians(90.0 - (np.arange(spec.n_rows) + 0.5) * spec.lat_step)
    lon = -180.0 + (np.arange(n) + 0.5) * spec.lon_step

    def km(r: int, c: np.ndarray, rr: np.ndarray, cc: np.ndarray) -> np.ndarray:
        a = np.sin((lat[rr] - lat[r]) / 2) ** 2
        a = a + np.cos(lat[r]) * np.cos(lat[rr]) * np.sin(np.radians(lon[cc] - lon[c]) / 2) ** 2
        return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(a, 0, 1)))

    def envelope(sites: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sites that are nearest somewhere, and where each one starts to be."""
        kept: list[int] = []
        starts: list[float] = []
        heights = gaps * gaps + sites * sites
        for i in range(len(sites)):
            start = -np.inf
            while kept:
                j = kept[-1]
                start = (heights[i] - heights[j]) / (2.0 * (sites[i] - sites[j]))
                if start >= starts[-1]:
                    break
                kept.pop()
                starts.pop()
                start = -np.inf
            kept.append(i)
            starts.append(start)
        return np.array(kept), np.array(starts)

    def one_row(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        cols = pdf["c"].to_numpy()
        r = int(pdf["r"].iloc[0])
        up, down = pdf["up"].to_numpy(dtype=float), pdf["down"].to_numpy(dtype=float)
        gap = np.fmin(up, down)
        has = np.flatnonzero(~np.isnan(gap))
        out = pdf.drop(columns=["up", "down"]).assign(index_distance2=pd.NA, km=np.nan)
        out["index_distance2"] = out["index_distance2"].astype("Int64")
        if len(has) == 0:
            return out
        site, g = cols[has].astype(float), gap[has]
        source = cols[has]
        if wrap:
            site = np.concatenate([site - n, site, site + n])
            g, source = np.tile(g, 3), np.tile(source, 3)
            has = np.tile(has, 3)
        kept, starts = envelope(site, g)
        # Sites whose stretch touches a column at one point are ties: first to last.
        last = np.searchsorted(starts, cols, side="right") - 1
        first = np.maximum(np.searchsorted(starts, cols, side="left") - 1, 0)
        best2 = (site[kept[last]] - cols) ** 2 + g[kept[last]] ** 2
        best = np.full(len(cols), np.inf)
        for back in range(int((last - first).max()) + 1):
            k = kept[np.maximum(last - back, first)]
            d2 = (site[k] - cols) ** 2 + g[k] ** 2
            same = d2 == best2
            for side, sign in ((up, -1), (down, 1)):
                at = side[has[k]]
                use = same & (at == g[k])
                if use.any():
                    rows = (r + sign * at[use]).astype(int)
                    best[use] = np.minimum(best[use], km(r, cols[use], rows, source[k][use]))
        out["index_distance2"] = best2.astype("int64")
        out["km"] = best
        return out

    return one_row


def distance_to_mask(mask: DataFrame, spec: GridSpec, by: Sequence[str] = (), wrap: bool = False) -> DataFrame:
    """Distance from every cell to the nearest masked cell; NULL when nothing is masked.

    ``mask`` holds the TRUE cells only. "Nearest" is Euclidean in index space,
    the result is the great-circle distance to that cell (the shorter one on
    ties). A column pass finds the nearest masked rows with window functions; a
    row pass over one grid row at a time (at most ``n_cols`` rows per group)
    takes the lower envelope. ``by`` carries several masks at once.
    """
    spark = mask.sparkSession
    true = mask.select(*by, "r", "c").distinct().withColumn("_hit", F.lit(True))
    dense = spec.cells(spark)
    if by:
        rows, cols = (F.sequence(F.lit(0), F.lit(n - 1).cast("long")) for n in (spec.n_rows, spec.n_cols))
        dense = mask.select(*by).distinct().withColumn("r", F.explode(rows)).withColumn("c", F.explode(cols))
    full = dense.join(true, [*by, "r", "c"], "left")
    column = Window.partitionBy(*by, "c").orderBy("r")
    hit_row = F.when(F.col("_hit"), F.col("r"))
    above = F.last(hit_row, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(hit_row, ignorenulls=True).over(column.rowsBetween(0, Window.unboundedFollowing))
    gaps = full.select(*by, "r", "c", (F.col("r") - above).alias("up"), (below - F.col("r")).alias("down"))
    keys = full.select(*by, "r", "c").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", index_distance2 long, km double"
    out = gaps.groupBy(*by, "r").applyInPandas(_row_pass(spec, wrap), schema)
    return out.withColumn("km", F.when(F.col("index_distance2").isNotNull(), F.col("km")))


# --- nearest neighbours ---------------------------------------------------------------------


def knn_haversine(points: DataFrame, k: int = 8, key: str = "id", lat: str = "lat", lon: str = "lon",
                  by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` nearest other points of each point (key, neighbour, km, rank), exact on the sphere.

    Ties in km, rounded to six places, go to the lower key. Points without a key or coordinates take no part; fewer than
    k + 1 points give what there is. See ``sphere_tree`` for the search.
    """
    return knn_on_sphere(points, k, key, lat, lon, by)


def morans_i(points: DataFrame, value: str, k: int = 8, key: str = "id", lat: str = "lat", lon: str = "lon",
             by: Sequence[str] = ()) -> DataFrame:
    """Row-standardised kNN Moran's I of a residual, overall or per group."""
    neighbours = knn_haversine(points, k, key, lat, lon, by)
    stats = points.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")
    )
    values = points.select(*by, key, F.col(value).alias("_v"))
    other = values.select(*by, F.col(key).alias("neighbour"), F.col("_v").alias("_u"))
    pairs = neighbours.join(values, [*by, key]).join(other, [*by, "neighbour"])
    if by:
        centred = pairs.join(stats.select(*by, "mean"), list(by))
    else:
        centred = pairs.withColumn("mean", stats.select("mean").scalar())
    cross = centred.groupBy(*by).agg(F.sum((F.col("_v") - F.col("mean")) * (F.col("_u") - F.col("mean"))).alias("cross"))
    spacing = exact_quantiles(neighbours, "km", {"median_neighbour_km": 0.5}, by)
    joined = stats
    for part in (cross, spacing):
        joined = joined.join(part, list(by)) if by else joined.withColumns({c: part.select(c).scalar() for c in part.columns})
    variance = F.col("n") * F.col("sd") * F.col("sd")
    return joined.select(
        *by, "n", F.col("mean").alias("residual_mean"), F.col("sd").alias("residual_sd"), "median_neighbour_km",
        F.when(variance > 0, F.col("cross") / (F.lit(k) * variance)).alias("morans_i"),
        (F.lit(-1.0) / (F.col("n") - 1)).alias("expected"),
    )
