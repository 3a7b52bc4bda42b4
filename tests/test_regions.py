"""Cells and boxes by a quadtree against comparing all of them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.operators import joins as J


def tables(spark, case):
    rng = np.random.default_rng(7)
    n = 400
    lat, lon = rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)
    if case == "one tile":
        lat, lon = 10 + rng.uniform(0, 0.01, n), 20 + rng.uniform(0, 0.01, n)
    lat[:6], lon[:6] = [90, -90, 0, 0, 45, 45], [180, -180, 0, 180, 90, -90]
    boxes = [("all", -90.0, 90.0, -180.0, 180.0), ("edge", 0.0, 45.0, 0.0, 90.0), ("point", 45.0, 45.0, 90.0, 90.0), ("empty", 10.0, 5.0, 0.0, 1.0),
             ("far", -1e9, 1e9, -1e9, 1e9), ("off", 100.0, 120.0, 0.0, 10.0)]
    for i in range(60):
        size = 10.0 ** rng.uniform(-3, 1.7)
        s, w = (10.0, 20.0) if case == "one tile" and i % 2 else (rng.uniform(-90, 89), rng.uniform(-180, 179))
        boxes.append((f"b{i}", float(s), float(s + size / 2), float(w), float(w + size)))
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "lat": lat, "lon": lon}))
    points = points.unionByName(spark.createDataFrame([(n, None, 1.0)], "id long, lat double, lon double"))
    return points, spark.createDataFrame(boxes, "region string, s_lat double, n_lat double, w_lon double, e_lon double"), lat, lon, boxes


@pytest.mark.parametrize("case", ["spread", "one tile"])
@pytest.mark.parametrize("hot", [5, 10**6])
def test_agrees_with_all_pairs(spark, case, hot):
    points, regions, lat, lon, boxes = tables(spark, case)
    got = sorted((r.id, r.region) for r in J.region_join(points, regions, hot_rows=hot).collect())
    want = sorted((i, b[0]) for i in range(len(lat)) for b in boxes if b[1] <= lat[i] <= b[2] and b[3] <= lon[i] <= b[4])
    assert got == want


def test_boxes_have_few_cells(spark):
    _, regions, *_ = tables(spark, "spread")
    counts = {r.region: r["count"] for r in J.cover(regions).groupBy("region").count().collect()}
    assert max(counts.values()) <= 100 and "empty" not in counts


def test_a_full_cell_is_dealt_into_parts(spark):
    points, regions, *_ = tables(spark, "one tile")
    dealt = []
    plan = J.region_join(points, regions.where("region = 'all'"), hot_rows=50)
    assert plan.count() == 400
    keyed = points.where("lat is not null").withColumn("part", F.pmod(F.xxhash64("id", "lat", "lon"), F.lit(8)))
    dealt = [r["count"] for r in keyed.groupBy("part").count().collect()]
    assert len(dealt) == 8 and max(dealt) < 100
