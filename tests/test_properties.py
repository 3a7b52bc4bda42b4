"""Invariants of sampling, crops, attribution and learned models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.fixtures import Views
from gridspark.models import mixture as X
from gridspark.models import share as S
from gridspark.models import two_stage as T
from gridspark.models.design import vectorized
from gridspark.operators import crops as C
from gridspark.operators import joins as J
from gridspark.operators import sampling as A
from gridspark.operators import shapley as H
from gridspark.queries.attributing import FEATURES, GROUPS, score
from gridspark.queries.modelling import NUMERIC, SMALL, crop_long, sample

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF)


def test_shares_sum_to_one(views):
    totals = C.crop_share(views.crop_area).groupBy("r", "c").agg(F.sum("share").alias("s"))
    assert totals.where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_topk_always_divides_by_k_and_ties_take_the_first_crop(spark):
    df = spark.createDataFrame([(0, 0, "a", 4.0), (0, 0, "b", 6.0), (0, 0, "z", 6.0)], "r long, c long, crop string, v double")
    assert C.topk_mean(df, "v").first().top_mean == pytest.approx(16.0 / 5)
    assert C.dominant_crop(df, "v").first().dominant == "b"


def test_joins_guard_their_promises(spark):
    a = spark.createDataFrame([(0, 0), (0, 0)], "r long, c long")
    with pytest.raises(ValueError):
        J.checked_join(a, a, ["r", "c"])
    with pytest.raises(ValueError):
        J.checked_join(a, a.distinct(), ["r", "c"], "m:1", expect_rows=3)


def test_case_control_is_exact_and_repeatable(views):
    cells = views.score.withColumn("presence", (F.col("x2") > 0.5).cast("int"))
    draw = lambda: {r.id for r in A.case_control_sample(cells, "id", "presence", 300, 200).collect()}
    first = draw()
    assert len(first) == 500 and first == draw()


def test_weighted_draw_hits_a_heavy_row_in_proportion(spark):
    pool = spark.createDataFrame(pd.DataFrame({"id": range(100), "w": [99.0] + [1.0] * 99}))
    draws = A.weighted_draw(pool, "id", "w", 2000)
    assert draws.count() == 2000
    assert draws.where("id = 0").count() == pytest.approx(1000, abs=120)


def test_group_folds_are_balanced_and_whole(views):
    folds = A.group_kfold(views.oof, "block")
    sizes = [r["count"] for r in A.with_folds(views.oof, folds, "block").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) < 1.5 * min(sizes)
    assert folds.count() == folds.select("block").distinct().count()


def test_shapley_is_efficient_for_groups_and_features(views):
    df = views.score.limit(200)
    pool = H.background_pool(df, "id", "w", FEATURES, 32)
    for out, names in (
        (H.group_shapley(df, "id", GROUPS, score, pool, 32, 3), GROUPS), (H.feature_shapley(df, "id", FEATURES, score, pool, 32, 6), FEATURES),
    ):
        total = sum((F.col(f"phi__{n}") for n in names), F.col("baseline"))
        assert out.where(F.abs(total - F.col("prediction")) > 1e-9).count() == 0


def test_column_and_frame_scores_agree(views):
    df = views.score.limit(150)
    pool = H.background_pool(df, "id", "w", FEATURES, 16)
    frame = lambda d: d.withColumn("score", score({f: F.col(f) for f in FEATURES}))
    for a, b in (
        (H.group_shapley(df, "id", GROUPS, score, pool, 16, 2), H.group_shapley_frame(df, "id", GROUPS, frame, pool, 16, 2)),
        (H.feature_shapley(df, "id", FEATURES, score, pool, 16, 4), H.feature_shapley_frame(df, "id", FEATURES, frame, pool, 16, 4)),
    ):
        left, right = a.toPandas().sort_values("id"), b.toPandas().sort_values("id")
        pd.testing.assert_frame_equal(left[sorted(left)].reset_index(drop=True), right[sorted(left)].reset_index(drop=True))


def test_permuted_rows_keep_each_fold_and_group_together(views):
    df = views.score.select("id", "fold", "x1", "x2", "x3", "x4")
    out = H.permuted_rows(df, "id", GROUPS, "fold", 2)
    assert out.count() == df.count() * 3 * 2
    moved = out.where("feature_group = 'a' AND rep = 1")
    pairs = lambda d: sorted((r.fold, r.x1, r.x2) for r in d.collect())
    assert pairs(moved) == pairs(df)


def test_two_stage_oof_is_complete_and_beats_the_mean(views):
    df = sample(views)
    oof, models, slots = T.two_stage_oof(df, NUMERIC, ["cls"], "fold", 0.5, params=SMALL)
    T.require_complete(oof, ["pred"])
    row = oof.agg(F.avg((F.col("pred") - F.col("y")) ** 2).alias("e"), F.var_pop("y").alias("v"), F.min("pred").alias("lo"), F.max("pred").alias("hi")).first()
    assert oof.count() == df.count() and row.e < row.v and 0 <= row.lo and row.hi <= 1
    shares = T.gain_importance(models, slots, views.spark).groupBy("fold", "stage").agg(F.sum("share").alias("s"))
    assert shares.where(F.abs(F.col("s") - 1) > 1e-6).count() == 0


def test_fractional_logit_recovers_its_mean(views):
    df = sample(views).where("presence = 1")
    model = S.fractional_logit(df, "y", NUMERIC, l2=0.0)
    row = df.agg(F.avg(model.mean()).alias("p"), F.avg("y").alias("y")).first()
    assert row.p == pytest.approx(row.y, abs=1e-4)


def test_softmax_share_lowers_the_loss_and_sums_to_one(views):
    long, crops = crop_long(views)
    fits = [S.softmax_share_linear(long, crops, ["rain", "irr"], "climate", "k0", max_iter=n) for n in (1, 6)]
    assert fits[1].loss <= fits[0].loss
    p = S.stable_softmax(long.withColumn("score", fits[1].score()), "score", ["r", "c"])
    assert p.groupBy("r", "c").agg(F.sum("p").alias("s")).where(F.abs(F.col("s") - 1) > 1e-9).count() == 0


def test_mixture_likelihood_rises(views):
    df = sample(views)
    fits = [X.em_two_stage_mixture(df, "y", "presence", NUMERIC, 2, max_iter=n, n_init=1) for n in (1, 3)]
    assert fits[1].loglik >= fits[0].loglik - 1e-6
    assert fits[0].parameter_count() == 19


def test_fractional_mixture_predicts_fractions(views):
    df = sample(views).where("presence = 1")
    mixture = X.em_fractional_mixture(df, "y", NUMERIC, 2, max_iter=2)
    data, _ = vectorized(df, NUMERIC)
    row = mixture.predict(data).agg(F.min("pred").alias("lo"), F.max("pred").alias("hi")).first()
    assert 0 < row.lo <= row.hi < 1


def test_correlation_p_values(spark):
    """Against Student's distribution by fine numerical integration."""
    import math

    from gridspark.operators import metrics as M

    def brute(t, df):
        u = (np.arange(200_000) + 0.5) / 200_000 * math.atan(abs(t) / math.sqrt(df))
        whole = (np.arange(200_000) + 0.5) / 200_000 * math.pi / 2
        part = (np.cos(u) ** (df - 1)).mean() * math.atan(abs(t) / math.sqrt(df))
        return 1 - part / ((np.cos(whole) ** (df - 1)).mean() * math.pi / 2)

    cases = [(t, n) for n in (3, 4, 5, 12, 101, 2000, 9000, 20_000) for t in (0.0, 0.01, -0.7, 1.96, 5.0)]
    df = spark.createDataFrame(cases, "t double, n long").withColumn("p", M.correlation_p(F.col("t"), F.col("n")))
    for r in df.collect():
        assert abs(r.p - brute(r.t, r.n - 2)) < 2e-7, (r.t, r.n)


def test_cached_layers_follow_their_sources(spark, tmp_path):
    from gridspark.functions.grid import GridSpec
    from gridspark.sources import tables

    spec, built = GridSpec(2, 2), []
    for name, value in (("one", 1.0), ("two", 2.0), ("two", 2.0)):
        source = str(tmp_path / name)
        if name not in built:
            spark.createDataFrame([(0, 0, value)], "r long, c long, v double").write.parquet(source)
        build = lambda s=source, n=name: (built.append(n), spark.read.parquet(s))[1]
        layer = tables.load_or_build(spark, str(tmp_path / "cache"), spec, build, sources=[source])
        assert [r.v for r in layer.collect()] == [value]
    assert built == ["one", "two"]


def test_ranges_split_equal_values_and_any_number_of_groups(spark):
    from gridspark.operators import scan

    df = spark.range(1500).select("id", (F.col("id") % 75).cast("string").alias("g"), F.lit(1.0).alias("x"))
    parts = scan.add_range(df, "x", ["g"], split_rows=10, ties=["id"])
    most = parts.groupBy("g", scan.BUCKET).count().agg(F.max("count"), F.count("count")).first()
    assert most[1] > 100 and parts.select(scan.BUCKET).distinct().count() > 100
    rn = scan.numbered(df, "x", ["id"], ["g"], "rn", split_rows=10)
    assert rn.where(F.col("rn") != F.floor(F.col("id") / 75) + 1).count() == 0
