"""Trees grown side by side against Spark's own, and rounds of regimes against rows."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from gridspark.models import batch_trees as T
from gridspark.models import mixture as X
from gridspark.models import two_stage as M
from gridspark.models.design import vectorized
from gridspark.models.two_stage import BINNED, TreeParams, fit_two_stage, fit_two_stages, learn_bins

PARAMS = TreeParams(class_trees=4, fraction_trees=4, max_depth=3, class_min_rows=20, fraction_min_rows=20, subsample=1.0, max_bins=16)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    n = 3000
    a, b, c = rng.random(n), rng.normal(size=n), rng.integers(0, 4, n)
    d = (rng.random(n) < 1 / (1 + np.exp(-3 * a - b + c + rng.normal(size=n)))).astype(int)
    y = np.where(d, np.clip(0.2 + 0.5 * a + 0.1 * (c == 2) + 0.05 * rng.normal(size=n), 0, 1), 0.0)
    df = spark.createDataFrame([(i, *map(float, r[:2]), str(r[2]), int(r[3]), float(r[4])) for i, r in enumerate(zip(a, b, c, d, y))], "id long, a double, b double, c string, presence int, y double")
    return vectorized(df, ["a", "b"], ["c"])[0].persist()


def test_trees_are_those_of_spark(rows):
    model = fit_two_stage(rows, "y", "presence", PARAMS)
    cells = model.bins.collapse(rows, ["presence"], F.lit(1.0), _fraction=F.col("y")).withColumn("_label", F.col("presence").cast("double")).coalesce(1).persist()
    n, present = rows.count(), rows.where("presence = 1").count()
    shared = {"featuresCol": BINNED, "weightCol": "_weight", "maxDepth": 3, "maxBins": 32, "stepSize": 0.1, "maxIter": 4}
    p = GBTClassifier(labelCol="_label", minWeightFractionPerNode=20 / n, **shared).fit(cells)
    q = GBTRegressor(labelCol="_fraction", minWeightFractionPerNode=20 / present, **shared).fit(cells.where("presence = 1"))
    scored = model.score(rows, model.sample_prior)
    own = model.bins.transform(rows)
    want = q.transform(p.transform(own).withColumn("want_p", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")).select("id", "want_p", F.col("prediction").alias("want_q"))
    gap = scored.join(want, "id").agg(F.max(F.abs(F.col("p") - F.col("want_p"))), F.max(F.abs(F.col("q") - F.greatest(F.lit(0.0), F.least(F.lit(1.0), "want_q"))))).first()
    assert max(gap) < 1e-9
    np.testing.assert_allclose(model.classifier.featureImportances.toArray(), p.featureImportances.toArray(), atol=0.01)
    np.testing.assert_allclose(model.presence.importances(), model.classifier.featureImportances.toArray(), atol=1e-6)


def test_side_by_side_is_as_each_alone_and_takes_no_more_passes(rows, monkeypatch):
    halves = [rows.where("id % 2 = 0"), rows.where("id % 2 = 1")]
    passes, whole, grow = [], T.added, T.grow
    monkeypatch.setattr(T, "added", lambda *a: passes.append(1) or whole(*a))
    monkeypatch.setattr(M, "grow", lambda *a: grow(*a, few_cells=0))
    both = fit_two_stages(halves, "y", "presence", TreeParams(**PARAMS.__dict__ | {"subsample": 0.8}))
    assert 0 < len(passes) <= 4 * 3
    monkeypatch.setattr(M, "grow", grow)
    for half, model in zip(halves, both, strict=True):
        alone = fit_two_stage(half, "y", "presence", TreeParams(**PARAMS.__dict__ | {"subsample": 0.8}))
        np.testing.assert_allclose(alone.presence.table, model.presence.table, atol=1e-9)
        np.testing.assert_allclose(alone.fraction.table, model.fraction.table, atol=1e-9)
    assert len(passes) <= 4 * 3


def test_tables_columns_and_walks_agree(rows):
    model = fit_two_stage(rows, "y", "presence", PARAMS)
    b = np.indices(model.bins.sizes).reshape(3, -1)
    np.testing.assert_allclose(model.presence.table, 1 / (1 + np.exp(-2 * model.presence.margin(b))))
    binned, names = model.bins.columns(model.score(rows, 0.3))
    got = binned.select(*names, "p_cal", "q").toPandas()
    own = got[names].to_numpy().astype(int).T
    np.testing.assert_allclose(got["p_cal"], model.calibrated(own, 0.3), rtol=1e-9)
    np.testing.assert_allclose(got["q"], np.clip(model.fraction.predict(own), 0, 1), rtol=1e-9)


def test_sums_by_bins_are_those_of_rows(rows):
    """What a pass leaves for the trees, from the responsibilities of every row."""
    model = X.moe_regimes(rows, "y", "presence", 2, 0.3, iters=1, params=PARAMS)
    assert len(model.experts) == 2 and all(s >= 0.05 for s in model.sigmas)
    state = (model.experts, model.sigmas, [0.5, 0.5], 0.3)
    binned, names = model.bins.columns(rows)
    local = binned.select(*names, F.col("presence").cast("double").alias("d"), "y").toPandas()
    b, d, y = local[names].to_numpy().astype(np.int64).T, local["d"].to_numpy(), local["y"].to_numpy()
    r = X._responsibilities(state, 2, b, d, y, None)
    np.testing.assert_allclose(r.sum(axis=0), 1)
    dense = []
    for j, e in enumerate(model.experts):
        p, q = e.calibrated(b, 0.3), np.clip(e.fraction.predict(b), 0, 1)
        dense.append(np.where(d == 1, p * np.exp(-((y - q) ** 2) / (2 * model.sigmas[j] ** 2)) / model.sigmas[j], 1 - p))
    np.testing.assert_allclose(r, np.array(dense) / np.sum(dense, axis=0), rtol=1e-9)
    sums = [f"{x}{j}" for j in range(2) for x in "awstg"]
    schema = ", ".join([*[f"{n} short" for n in names], "_label double", "n long", *[f"{x} double" for x in sums]])
    base = binned.select(*[F.col(n).cast("short").alias(n) for n in names], F.col("presence").cast("double").alias("_label"), "y", F.lit(0).alias("_start"))
    got = base.mapInArrow(X._by_bins(state, 2, 1e-3, names), schema).agg(F.sum("n"), *[F.sum(x) for x in sums]).first()
    want = [len(y)]
    for j in range(2):
        w = np.maximum(r[j], 1e-3)
        want += [r[j].sum(), w.sum(), (w * y).sum(), (w * y * y).sum(), r[j][r.argmax(axis=0) == j].sum()]
    np.testing.assert_allclose(list(got), want, rtol=1e-9)
    assert base.mapInArrow(X._by_bins(state, 2, 1e-3, names), schema).count() < rows.count()


def test_rows_without_presence_or_fraction_are_refused(rows):
    for change in ({"presence": F.when(F.col("id") > 5, F.col("presence"))}, {"y": F.when(F.col("id") > 100, F.col("y"))}):
        with pytest.raises(Exception):
            fit_two_stage(rows.withColumns(change), "y", "presence", PARAMS)
        with pytest.raises(ValueError):
            X.moe_regimes(rows.withColumns(change), "y", "presence", 2, 0.3, iters=1, params=PARAMS)


def test_combinations_are_told_apart_however_many():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 3, 200) * 40 for _ in range(14)]
    codes = X._row_codes(columns)
    assert len(np.unique(codes)) == len(np.unique(np.array(columns).T, axis=0))
