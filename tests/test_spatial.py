"""Neighbourhood operators on small grids with known answers and by brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.functions.grid import GridSpec
from gridspark.operators import neighbor as N
from gridspark.operators import sphere_tree
from gridspark.operators import regrid as R
from gridspark.operators import zones as Z

SPEC = GridSpec(18, 36)


def cells(spark, values):
    rows = [(int(r), int(c), float(values[r, c])) for r in range(values.shape[0]) for c in range(values.shape[1]) if not np.isnan(values[r, c])]
    return spark.createDataFrame(rows, "r long, c long, value double")


def brute_mean(v, spec, radius, min_valid=0.25):
    km = 6371.0088 * np.pi / 180
    tall = max(1, int(np.ceil(radius / (km * spec.lat_step))))
    lat = 90 - (np.arange(spec.n_rows) + 0.5) * spec.lat_step
    half = np.minimum(np.ceil(radius / (km * np.maximum(np.cos(np.radians(lat)), 1e-6) * spec.lon_step)).astype(int), spec.n_cols // 2 - 1)
    out = np.full(v.shape, np.nan)
    for r in range(spec.n_rows):
        rows = np.clip(np.arange(r - tall, r + tall + 1), 0, spec.n_rows - 1)
        for c in range(spec.n_cols):
            box = np.concatenate([v[rr, np.arange(c - half[rr], c + half[rr] + 1) % spec.n_cols] for rr in rows])
            ok = ~np.isnan(box)
            if ok.sum() and ok.sum() >= min_valid * len(box):
                out[r, c] = box[ok].mean()
    return out


def dense(df, spec, col):
    out = np.full((spec.n_rows, spec.n_cols), np.nan)
    for row in df.select("r", "c", col).collect():
        out[row.r, row.c] = np.nan if row[2] is None else row[2]
    return out


@pytest.mark.parametrize("radius", [600.0, 2500.0])
def test_box_mean(spark, radius):
    rng = np.random.default_rng(0)
    v = rng.random((18, 36))
    v[rng.random(v.shape) < 0.6] = np.nan
    got = dense(N.box_mean_km(cells(spark, v), SPEC, radius), SPEC, "mean")
    np.testing.assert_allclose(got, brute_mean(v, SPEC, radius), atol=1e-9)


def test_box_mean_of_constant_and_wrap(spark):
    constant = N.box_mean_km(cells(spark, np.full((18, 36), 7.0)), SPEC, 900.0)
    assert constant.where(F.abs(F.col("mean") - 7.0) > 1e-9).count() == 0
    one = np.full((18, 36), np.nan)
    one[9, 0] = 1.0
    total = dense(N.box_sum_km(cells(spark, one), SPEC, 1000.0), SPEC, "total")
    assert total[9, 35] == pytest.approx(1.0) and total[9, 18] == pytest.approx(0.0)


@pytest.mark.parametrize("wrap", [False, True])
@pytest.mark.parametrize("share", [0.01, 0.2])
def test_distance(spark, wrap, share):
    rng = np.random.default_rng(3)
    hit = np.argwhere(rng.random((18, 36)) < share)
    mask = spark.createDataFrame([(int(a), int(b)) for a, b in hit], "r long, c long")
    got = N.distance_to_mask(mask, SPEC, wrap=wrap).toPandas().set_index(["r", "c"])
    lat, lon = np.radians(90 - (np.arange(18) + 0.5) * 10), np.radians(-180 + (np.arange(36) + 0.5) * 10)
    for r in range(18):
        for c in range(36):
            dc = np.abs(hit[:, 1] - c)
            if wrap:
                dc = np.minimum(dc, 36 - dc)
            d2 = (hit[:, 0] - r) ** 2 + dc**2
            near = hit[d2 == d2.min()]
            a = np.sin((lat[near[:, 0]] - lat[r]) / 2) ** 2 + np.cos(lat[r]) * np.cos(lat[near[:, 0]]) * np.sin((lon[near[:, 1]] - lon[c]) / 2) ** 2
            row = got.loc[(r, c)]
            assert row.index_distance2 == d2.min()
            assert row.km == pytest.approx(2 * 6371.0088 * np.arcsin(np.sqrt(a)).min(), abs=1e-6)


def test_distance_of_empty_mask(spark):
    empty = spark.createDataFrame([], "r long, c long")
    out = N.distance_to_mask(empty, SPEC)
    assert out.count() == 18 * 36 and out.where("km IS NOT NULL").count() == 0


def test_knn_with_a_third_of_the_points_in_one_place(spark):
    rng = np.random.default_rng(5)
    n = 300
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)
    lat[:100], lon[:100] = 10.0, 20.0
    lat[100:140], lon[100:140] = rng.uniform(88, 90, 40), rng.uniform(-180, 180, 40)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "lat": lat, "lon": lon}))
    got = N.knn_haversine(df, 5).toPandas()
    p, q = np.radians(lat), np.radians(lon)
    a = np.sin((p[:, None] - p) / 2) ** 2 + np.cos(p[:, None]) * np.cos(p) * np.sin((q[:, None] - q) / 2) ** 2
    km = np.round(2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(a, 0, 1))), 6)
    np.fill_diagonal(km, np.inf)
    assert len(got) == n * 5
    for i, part in got.groupby("id"):
        want = sorted(zip(km[i], range(n)))[:5]
        assert list(part.sort_values("rank").neighbour) == [j for _, j in want]


def nearest(lat, lon, k):
    p, q = np.radians(lat), np.radians(lon)
    a = np.sin((p[:, None] - p) / 2) ** 2 + np.cos(p[:, None]) * np.cos(p) * np.sin((q[:, None] - q) / 2) ** 2
    km = np.round(2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(a, 0, 1))), 6)
    np.fill_diagonal(km, np.inf)
    return [[j for _, j in sorted(zip(row, range(len(row))))[:k]] for row in km]


@pytest.mark.parametrize("case", ["crowd", "close", "grid"])
def test_knn_where_points_are_uneven(spark, case, monkeypatch):
    """Most points in one degree and a few far away; all within a metre; a grid with many ties at the pole and date line."""
    rng = np.random.default_rng(2)
    if case == "crowd":
        lat = np.concatenate([45 + rng.normal(0, 0.1, 700), rng.uniform(-90, 90, 40)])
        lon = np.concatenate([10 + rng.normal(0, 0.1, 700), rng.uniform(-180, 180, 40)])
    elif case == "close":
        lat, lon = 45 + 1e-6 * rng.random(150), 10 + 1e-6 * rng.random(150)
    else:
        lat, lon = (x.ravel() for x in np.meshgrid(np.arange(60, 91, 3.0), np.arange(-180, 181, 15.0)))
    n = len(lat)
    largest = []
    kept = sphere_tree._kept
    monkeypatch.setattr(sphere_tree, "_kept", lambda pairs, wanted: largest.append(pairs.groupBy("q_id").count().agg(F.max("count")).first()[0]) or kept(pairs, wanted))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "lat": lat, "lon": lon}))
    got = sphere_tree.knn_on_sphere(df, 4, "id", "lat", "lon", (), leaf_places=8).toPandas().sort_values(["id", "rank"])
    assert [list(part.neighbour) for _, part in got.groupby("id")] == nearest(lat, lon, 4)
    if case == "crowd":
        assert max(largest) < n  # no leaf meets a candidate list of the table's size


def test_knn_defines_small_and_null_inputs(spark):
    rows = [(1, 0.0, 0.0, "a"), (2, 0.0, 1.0, "a"), (3, None, 1.0, "a"), (None, 0.0, 2.0, "a"), (4, 0.0, 3.0, "b"), (5, 0.0, 4.0, None), (6, 0.0, 5.0, None)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, g string")
    got = sorted((r.g or "", r.id, r.neighbour, r["rank"]) for r in N.knn_haversine(df, 3, by=["g"]).collect())
    assert got == [("", 5, 6, 1), ("", 6, 5, 1), ("a", 1, 2, 1), ("a", 2, 1, 1)]
    assert N.knn_haversine(df.limit(0), 3).count() == 0


def test_moran_of_a_constant_is_null(spark):
    pdf = pd.DataFrame({"id": np.arange(40), "lat": np.linspace(-40, 40, 40), "lon": np.linspace(0, 90, 40), "v": 1.5})
    assert N.morans_i(spark.createDataFrame(pdf), "v", k=3).first().morans_i is None


def test_regrid_conserves_and_interpolates(spark):
    v = np.arange(12 * 24, dtype=float).reshape(12, 24)
    src, dst = GridSpec(12, 24), GridSpec(9, 10)
    total = R.regrid(cells(spark, v), src, dst, "sum", "value", "r", "c").agg(F.sum("value")).first()[0]
    assert total == pytest.approx(v.sum())
    same = R.regrid(cells(spark, v), src, src, "bilinear", "value", "r", "c")
    np.testing.assert_allclose(dense(same, src, "value"), v)
    with pytest.raises(ValueError):
        R.regrid(cells(spark, v), src, dst, "cubic", "value", "r", "c")


def test_zone_of_a_square(spark):
    ring = [(-20.0, -20.0), (20.0, -20.0), (20.0, 20.0), (-20.0, 20.0)]
    vertices = spark.createDataFrame([("z", 0, i, x, y) for i, (x, y) in enumerate(ring)], "zone string, ring int, seq int, lon double, lat double")
    got = {(r.r, r.c) for r in Z.rasterize_zones(Z.edges(vertices), SPEC).collect()}
    assert got == {(r, c) for r in range(7, 11) for c in range(16, 20)}


def test_box_sums_do_not_drift_next_to_a_large_value(spark):
    rows = [(r, c, 1e12 if (r, c) == (10, 10) else 0.05) for r in range(36) for c in range(72)]
    layer = spark.createDataFrame(rows, "r int, c int, value double")
    got = {(x["r"], x["c"]): x["total"] for x in N.box_sum_km(layer, GridSpec(36, 72), 1000.0).collect()}
    far = [v for (r, c), v in got.items() if abs(r - 10) > 4]
    assert far and all(abs(v * 20 - round(v * 20)) < 1e-9 for v in far)
