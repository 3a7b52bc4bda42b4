"""Order statistics with groups split into ranges, against NumPy. One group holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.operators import metrics, scan


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({
        "id": np.arange(n), "g": np.where(rng.random(n) < 0.7, "hot", np.where(rng.random(n) < 0.5, "a", "b")),
        "x": np.round(rng.lognormal(0, 2, n), 2), "w": rng.integers(1, 9, n).astype(float),
    })
    pdf.loc[rng.random(n) < 0.3, "x"] = 0.0
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("split", [100, 10**9])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles(table, split, by):
    pdf, df = table
    probs = {"q01": 0.01, "q33": 0.33, "q50": 0.5, "q100": 1.0}
    got = scan.exact_quantiles(df, "x", probs, by, split_rows=split).toPandas()
    for _, row in got.iterrows():
        part = pdf[pdf.g == row.g] if by else pdf
        np.testing.assert_allclose([row[k] for k in probs], np.quantile(part.x, list(probs.values())))


@pytest.mark.parametrize("split", [100, 10**9])
def test_running_sums_and_numbers(table, split):
    pdf, df = table
    got = scan.numbered(df, "x", ["id"], ["g"], "rn", "size", split_rows=split).toPandas().sort_values("id")
    ordered = pdf.sort_values(["g", "x", "id"])
    want = (ordered.groupby("g").cumcount() + 1).sort_index()
    assert (got.rn.to_numpy() == want.to_numpy()).all()
    assert (got["size"].to_numpy() == pdf.groupby("g").id.transform("size").to_numpy()).all()


@pytest.mark.parametrize("split", [100, 10**9])
@pytest.mark.parametrize("variant", ["total", "midpoint"])
def test_weighted_quantiles(table, split, variant):
    pdf, df = table
    q = {"a": 0.05, "b": 0.4, "c": 0.77, "d": 0.999}
    got = scan.weighted_quantiles(df, "x", "w", q, ["g"], variant, split_rows=split).toPandas()
    for _, row in got.iterrows():
        part = pdf[pdf.g == row.g].sort_values(["x", "w"])
        cum = part.w.cumsum() - (part.w / 2 if variant == "midpoint" else 0)
        np.testing.assert_allclose([row[k] for k in q], np.interp(list(q.values()), cum / part.w.sum(), part.x))


@pytest.mark.parametrize("split", [100, 10**9])
def test_first_n_beyond_one_range(table, split):
    pdf, df = table
    got = scan.first_n(df, "x", ["id"], 700, ["g"], split_rows=split).toPandas()
    want = pdf.sort_values(["x", "id"]).groupby("g").head(700)
    assert set(got.id) == set(want.id)


@pytest.mark.parametrize("split", [2, 10**9])
def test_null_group_is_kept(spark, split):
    df = spark.createDataFrame([(None, float(i)) for i in range(9)] + [("a", 5.0)], "g string, x double")
    got = {r.g: r.m for r in scan.exact_quantiles(df, "x", {"m": 0.5}, ["g"], split_rows=split).collect()}
    assert got == {None: 4.0, "a": 5.0}
    first = scan.first_n(df, "x", [], 4, ["g"], split_rows=split)
    assert sorted(r.x for r in first.where("g IS NULL").collect()) == [0.0, 1.0, 2.0, 3.0]


def test_average_ranks(table):
    pdf, df = table
    got = scan.average_ranks(df, "x", split_rows=100).toPandas().set_index("x")["rank"]
    want = pdf.assign(r=pdf.x.rank()).groupby("x").r.first()
    pd.testing.assert_series_equal(got.sort_index(), want, check_names=False)


def test_plan_has_no_single_partition_window_when_split(table):
    _, df = table
    out = scan.running_sums(df, "x", {"c": "w"}, ties=["id"], split_rows=100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in plan
    assert out.agg(F.max("c")).first()[0] == pytest.approx(table[0].w.sum())


def test_quantiles_plan_without_a_job(spark, table):
    _, df = table
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    scan.exact_quantiles(df, "x", {"q": 0.5}, ["g"])
    scan.weighted_quantiles(df, "x", "w", {"q": 0.5}, ["g"])
    scan.average_ranks(df, "x", ["g"])
    assert jobs() == before


def test_bins_rise_with_values_and_stay_small(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([
        rng.normal(0, 1e-9, 500) + 1, rng.normal(0, 1, 500), 10.0 ** rng.uniform(-300, 300, 300), -(10.0 ** rng.uniform(-300, 300, 300)),
        [0.0, np.inf, -np.inf, 5e-324, -5e-324, 1.7e308],
    ])
    df = spark.createDataFrame([(float(v),) for v in np.unique(x)], "x double")
    rows = sorted((r.x, tuple(r._bin)) for r in scan.with_bins(df, "x", bin_rows=10).collect())
    bins = [b for _, b in rows]
    assert bins == sorted(bins) and len(rows) == len(np.unique(x))
    assert max(bins.count(b) for b in set(bins)) <= 10


@pytest.mark.parametrize("split", [5, 10**9])
def test_weighted_quantiles_do_not_depend_on_the_split(spark, split):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"x": rng.normal(1, 1e-6, 2000), "w": rng.random(2000) ** 8})
    got = scan.weighted_quantiles(spark.createDataFrame(pdf), "x", "w", {"a": 0.1, "b": 0.9}, split_rows=split).first()
    want = scan.weighted_quantiles(spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(7), "x", "w", {"a": 0.1, "b": 0.9}, split_rows=100).first()
    assert got == want


def test_rank_correlation_of_a_column_of_zeros(spark):
    """One column is zero in 99 of 100 rows, and its rows are dealt into parts."""
    rng = np.random.default_rng(6)
    n = 3000
    pdf = pd.DataFrame({"x": np.where(rng.random(n) < 0.99, 0.0, rng.random(n)), "y": rng.normal(size=n).round(1), "z": rng.random(n)})
    pdf["y"] += pdf.x * 3
    pdf.loc[::50, "z"] = np.nan
    df = spark.createDataFrame(pdf).select("x", "y", F.when(~F.isnan("z"), F.col("z")).alias("z"))
    want = pdf.dropna().rank().corr()
    got = {(r.a, r.b): r.spearman for r in metrics.spearman_matrix(df, ["x", "y", "z"], hot_rows=100).collect()}
    assert all(abs(got[a, b] - want.loc[a, b]) < 1e-9 for a in "xyz" for b in "xyz")
    both = metrics.spearman(df, "x", "y").first()[0]
    assert abs(both - pdf[["x", "y"]].rank().corr().iloc[0, 1]) < 1e-9


def test_look_up_deals_hot_keys(spark):
    rows = spark.createDataFrame([(1, i) for i in range(400)] + [(2, 1), (None, 5), (9, 9)], "k long, x long")
    facts = spark.createDataFrame([(1, 400, "a"), (2, 1, "b"), (None, 1, "c")], "k long, n long, v string")
    got = sorted(((r.k or 0, r.x, r.v) for r in scan.look_up(rows, facts, ["k"], "n", hot_rows=50).collect()))
    assert got == sorted([(1, i, "a") for i in range(400)] + [(2, 1, "b"), (0, 5, "c")])
