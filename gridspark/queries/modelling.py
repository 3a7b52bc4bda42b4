"""Models. Learned values have no SQL of their own, so these queries return what any right fit must satisfy
(completeness, calibration, optimality, conservation), next to the observed values, and SQL states it."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.fixtures import duck
from gridspark.models import batch_em as B
from gridspark.models import embedding as E
from gridspark.models import mixture as X
from gridspark.models import share as S
from gridspark.models import two_stage as T
from gridspark.models.design import design_vector, standardize_design, vectorized
from gridspark.operators import shapley as H
from gridspark.operators.summary import to_wide
from gridspark.queries.registry import big, bigs, query, r6
from gridspark.session import cut_lineage

# Fewer trees than the library's default of 100, which callers get: boosting runs a job per tree level.
SMALL = T.TreeParams(class_trees=12, fraction_trees=12, class_step=0.3, fraction_step=0.3, max_depth=4)
NUMERIC = ["x1", "x3", "x4"]


def sample(v):
    """Presence and fraction follow the features with noise from the key."""
    noise = (F.col("id") % 7 - 3) / 10.0
    latent = F.col("x1") * 2.0 - F.col("x3") + F.col("x4") + noise
    presence = (latent > 1.0).cast("int")
    y = F.when(presence == 1, F.least(F.greatest(0.2 + 0.3 * F.col("x4") + 0.2 * F.col("x1") + noise / 5, F.lit(0.02)), F.lit(0.98))).otherwise(0.0)
    return v.score.withColumn("presence", presence).withColumn("y", y)


# The same table as SQL.
SAMPLE = """, z AS (SELECT *, (id % 7 - 3) / CAST(10.0 AS DOUBLE) AS noise FROM v_score),
    sm AS (SELECT *, CASE WHEN x1 * 2.0 - x3 + x4 + noise > 1.0 THEN 1 ELSE 0 END AS presence FROM z),
    s AS (SELECT *, CASE WHEN presence = 1 THEN least(greatest(0.2 + 0.3 * x4 + 0.2 * x1 + noise / 5, 0.02), 0.98) ELSE 0.0 END AS y FROM sm)"""
PRIOR = 0.3


@query("two_stage_oof", duck("v_score") + SAMPLE + f"SELECT id, {bigs('fold', 'presence')}, {r6('y')}, TRUE AS complete, TRUE AS calibrated, TRUE AS is_product FROM s")
def _(v):
    oof, models, _ = T.two_stage_oof(sample(v), NUMERIC, ["cls"], "fold", PRIOR, params=SMALL)
    share = F.element_at(F.create_map(*[F.lit(x) for k, m in models.items() for x in (k, m.sample_prior)]), F.col("fold").cast("int"))
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    up, down = p * PRIOR / share, (1 - p) * (1 - PRIOR) / (1 - share)
    whole = F.col("p").between(0, 1) & F.col("q").between(0, 1) & F.col("pred").between(0, 1)
    return oof.select(
        "id", "fold", "presence", "y", F.coalesce(whole, F.lit(False)).alias("complete"), (F.abs(F.col("p_cal") - up / (up + down)) < 1e-4).alias("calibrated"),
        (F.abs(F.col("pred") - F.col("p_cal") * F.col("q")) < 1e-12).alias("is_product"),
    )


@query("gain_importance", duck("v_score") + f"SELECT DISTINCT {big('fold')}, stage, {big('4', 'n_features')}, {r6('1.0', 'total_share')} FROM v_score, (VALUES ('presence'), ('fraction')) t(stage)")
def _(v):
    _, models, slots = T.two_stage_oof(sample(v), NUMERIC, ["cls"], "fold", PRIOR, params=SMALL)
    gains = T.gain_importance(models, slots, v.spark)
    return gains.groupBy("fold", "stage").agg(F.count("feature").alias("n_features"), F.sum("share").alias("total_share"))


@query("feature_ablation", duck("v_score") + SAMPLE + f"""SELECT model, {big('n_features')}, count(*) AS n_cells, {r6('avg(y)', 'observed_mean')}, TRUE AS in_range
    FROM s, (VALUES ('basic', 2), ('plus_x4', 3)) t(model, n_features) GROUP BY ALL""")
def _(v):
    from gridspark.operators.metrics import regression_metrics

    specs = {"basic": ["x1", "cls"], "plus_x4": ["x1", "x4", "cls"]}
    runs = T.feature_ablation(sample(v), specs, ["cls"], "fold", PRIOR, params=SMALL)
    metrics = regression_metrics(runs, "y", "p", by=["model", "n_features"])
    return metrics.select("model", "n_features", "n_cells", "observed_mean", (F.col("predicted_mean").between(0, 1) & (F.col("rmse") < 1)).alias("in_range"))


# Class 2 never occurs in training, so its rows hold zeros.
DESIGN = """, t AS (SELECT k.fold, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x4) AS m4, stddev_pop(x4) AS s4 FROM (SELECT DISTINCT fold FROM v_score) k
    JOIN v_score s ON s.fold <> k.fold AND cls <> 2 GROUP BY k.fold)"""


def _designs(v, make):
    """The rows of every fold in the design that the other folds teach."""
    parts = [make(v.score.where((F.col("fold") != k) & (F.col("cls") != 2)), v.score.where(F.col("fold") == k))[1] for k in range(5)]
    return reduce(DataFrame.unionByName, parts)


@query("standardize_design", duck("v_score") + DESIGN + f""" SELECT id, {r6('(x1 - m1) / s1', 'z__x1')}, {r6('(x4 - m4) / s4', 'z__x4')}, {r6('CASE WHEN cls = 0 THEN 1.0 ELSE 0.0 END', 'cls__0')},
    {r6('CASE WHEN cls = 1 THEN 1.0 ELSE 0.0 END', 'cls__1')} FROM v_score JOIN t USING (fold)""")
def _(v):
    return _designs(v, lambda a, b: standardize_design(a, b, ["x1", "x4"], ["cls"], keep=["id"]))


@query("design_vector", duck("v_score") + DESIGN + f""" SELECT id, {r6('(x1 - m1) / s1', 'z__x1')}, {r6('CASE WHEN cls < 2 THEN 1.0 ELSE 0.0 END', 'known_class')}, {big('3', 'n_slots')} FROM v_score JOIN t USING (fold)""")
def _(v):
    values = vector_to_array("features")
    out = _designs(v, lambda a, b: design_vector(a, b, ["x1"], ["cls"], keep=["id"]))
    return out.select("id", values[0].alias("z__x1"), (values[1] + values[2]).alias("known_class"), F.size(values).cast("long").alias("n_slots"))


@query("fractional_logit", duck("v_score") + SAMPLE + f"SELECT count(*) AS n, {r6('sum(w * y) / sum(w)', 'mean_y')}, TRUE AS mean_kept FROM s WHERE presence = 1")
def _(v):
    # The intercept carries no penalty, so at the optimum the weighted mean of the predictions is that of the observations.
    df = sample(v).where("presence = 1")
    model = S.fractional_logit(df, "y", NUMERIC, "w")
    scored = df.withColumn("pred", model.mean())
    total = F.sum("w")
    return scored.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("w") * F.col("y")) / total).alias("mean_y"), (F.sum(F.col("w") * F.col("pred")) / total).alias("p")).select(
        "n", "mean_y", (F.abs(F.col("p") - F.col("mean_y")) < 1e-4).alias("mean_kept")
    )


CROP_FEATURES = ["rain", "irr"]


def crop_long(v):
    """Every cell with every crop: observed share (0 if absent), cell inputs, crop-varying climate input."""
    cells = v.cells.select("r", "c", (F.col("pot_rain") / 25.0 - 1.0).alias("rain"), (F.col("pot_irr") / 25.0 - 1.0).alias("irr"))
    crop = F.concat(F.lit("k"), F.expr("CAST(substr(crop, 7) AS INT) % 4").cast("string"))
    grouped = v.crop_area.groupBy("r", "c", crop.alias("crop")).agg(F.sum("area_ha").alias("a"), (F.avg("yield_kg_ha") / 40000.0).alias("climate"))
    totals = grouped.groupBy("r", "c").agg(F.sum("a").alias("t"))
    crops = ["k0", "k1", "k2", "k3"]
    full = cells.join(totals, ["r", "c"]).withColumn("crop", F.explode(F.array(*[F.lit(k) for k in crops])))
    joined = full.join(grouped, ["r", "c", "crop"], "left")
    return joined.select(
        "r", "c", "crop", "rain", "irr", F.coalesce("climate", F.lit(0.0)).alias("climate"), F.coalesce(F.col("a") / F.col("t"), F.lit(0.0)).alias("y"),
        F.lit(1.0).alias("w"),
    ), crops


CROP_LONG = """, ca AS (SELECT r, c, 'k' || (CAST(substr(crop, 7) AS INT) % 4) AS crop, sum(area_ha) AS a FROM v_crop_area GROUP BY ALL),
    tot AS (SELECT r, c, sum(a) AS t FROM ca GROUP BY ALL),
    long AS (SELECT r, c, k.crop, coalesce(a / t, 0.0) AS y FROM v_cells JOIN tot USING (r, c) CROSS JOIN (VALUES ('k0'), ('k1'), ('k2'), ('k3')) k(crop)
      LEFT JOIN ca USING (r, c, crop))"""


@query("softmax_share_linear", duck("v_cells", "v_crop_area") + CROP_LONG + f"SELECT crop, count(*) AS n, {r6('avg(y)', 'mean_share')}, TRUE AS mean_kept, TRUE AS sums_to_one FROM long GROUP BY crop")
def _(v):
    # Intercepts carry no penalty, so at the optimum every crop's mean predicted share is the observed one.
    long, crops = crop_long(v)
    model = S.softmax_share_linear(long, crops, CROP_FEATURES, "climate", "k0")
    shares = S.stable_softmax(long.withColumn("score", model.score()), "score", ["r", "c"])
    worst = shares.groupBy("r", "c").agg(F.abs(F.sum("p") - 1).alias("gap")).agg(F.max("gap")).scalar()
    per = shares.groupBy("crop").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_share"), F.avg("p").alias("p"))
    return per.select("crop", "n", "mean_share", (F.abs(F.col("p") - F.col("mean_share")) < 1e-3).alias("mean_kept"), (worst < 1e-9).alias("sums_to_one"))


@query("softmax_share_tree", duck("v_cells", "v_crop_area") + CROP_LONG + f"SELECT {bigs('r', 'c')}, count(*) AS n_crops, {r6('1.0', 'total')}, {r6('sum(y)', 'observed_total')} FROM long GROUP BY r, c")
def _(v):
    # Every cell is predicted by trees that have not seen it.
    long, _ = crop_long(v)
    long = long.persist()
    fold = (F.col("r") + F.col("c")) % 4
    one = lambda k: S.softmax_share_tree(long.where(fold != k), long.where(fold == k), [*CROP_FEATURES, "climate"], ["crop"], trees=SMALL.class_trees, max_depth=SMALL.max_depth)
    parts = T.side_by_side(one, range(4))
    out = cut_lineage(reduce(DataFrame.unionByName, parts))
    long.unpersist()
    return out.groupBy("r", "c").agg(F.count("p").alias("n_crops"), F.sum("p").alias("total"), F.sum("y").alias("observed_total"))


@query("stable_softmax", duck("v_crop_area") + f""", s AS (SELECT r, c, crop, area_ha / 10 AS score FROM v_crop_area),
    m AS (SELECT *, exp(greatest(score - max(score) OVER (PARTITION BY r, c), -50)) AS e FROM s)
    SELECT {bigs('r', 'c')}, crop, {r6('e / sum(e) OVER (PARTITION BY r, c)', 'p')} FROM m""")
def _(v):
    return S.stable_softmax(v.crop_area.withColumn("score", F.col("area_ha") / 10), "score", ["r", "c"]).select("r", "c", "crop", "p")


COMPONENTS = """, l AS (SELECT id, k, CASE k WHEN 0 THEN -3 * abs(x1 - 0.2) WHEN 1 THEN -2 * abs(x2 - 0.5) ELSE -4 * abs(x3 - x4) END AS ll,
    CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.2 END AS pi FROM v_score, (VALUES (0), (1), (2)) t(k))"""


@query("logsumexp_posterior", duck("v_score") + COMPONENTS + f""", s AS (SELECT *, ll + ln(pi) AS s, max(ll + ln(pi)) OVER (PARTITION BY id) AS m FROM l),
    e AS (SELECT *, sum(exp(s - m)) OVER (PARTITION BY id) AS t, first_value(k) OVER (PARTITION BY id ORDER BY s DESC, k) AS label FROM s)
    SELECT id, {big('k')}, {r6('exp(s - m) / t', 'posterior')}, {r6('m + ln(t)', 'loglik_total')}, {big('label')}, {r6('1 / t', 'confidence')} FROM e""")
def _(v):
    parts = F.array(
        F.struct(F.lit(0).alias("k"), (-3.0 * F.abs(F.col("x1") - 0.2)).alias("ll"), F.lit(0.5).alias("pi")),
        F.struct(F.lit(1).alias("k"), (-2.0 * F.abs(F.col("x2") - 0.5)).alias("ll"), F.lit(0.3).alias("pi")),
        F.struct(F.lit(2).alias("k"), (-4.0 * F.abs(F.col("x3") - F.col("x4"))).alias("ll"), F.lit(0.2).alias("pi")),
    )
    long = v.score.select("id", F.explode(parts).alias("e")).select("id", "e.*")
    return X.posterior(long, "ll", "pi", ["id"]).select("id", "k", "posterior", "loglik_total", "label", "confidence")


KS, FOLDS = [1, 2, 3, 4], list(range(5))


def _chosen(fits, table):
    """The fit on all rows of the k with the greatest held-out likelihood."""
    best = max(table.collect(), key=lambda r: (r["oof_loglik"], -r["k"]))["k"]
    return next(f for f in fits if f.held is None and f.k == best)


@query("em_fractional_mixture", duck("v_score") + SAMPLE + f"SELECT id, {r6('y')}, TRUE AS in_range, {r6('1.0', 'posterior_total')}, TRUE AS never_falls FROM s WHERE presence = 1")
def _(v):
    df = sample(v).where("presence = 1")
    fits = B.fit_mixtures(df, "y", NUMERIC, KS, "fold", FOLDS)
    mixture = B.as_fractional(_chosen(fits, B.holdout_table(v.spark, fits)), NUMERIC)
    scored = mixture.predict(df)
    resp = mixture.responsibilities(F.least(F.greatest(F.col("y"), F.lit(X.EPS)), F.lit(1 - X.EPS)))
    whole = reduce(lambda a, b: a + b, resp)
    return scored.select("id", "y", F.col("pred").between(0, 1).alias("in_range"), whole.alias("posterior_total"), F.lit(X.never_falls(mixture.path)).alias("never_falls"))


def _selection_sql(where: str, per: str, k: str = "range(1, 5) t(k)") -> str:
    return f"""SELECT {big('k')}, count(*) AS n, {big(per, 'n_parameters')}, count(*) AS oof_n, TRUE AS never_falls, TRUE AS held_out_is_close, TRUE AS bic_fits, {big('1', 'choices_by_bic')},
      {big('1', 'choices_by_oof')} FROM s, {k} {where} GROUP BY k"""


def _selection(v, fits):
    """Fits of all sizes side by side with both choices of k; every row is held out once."""
    table = X.bic_select(B.holdout_table(v.spark, fits)).persist()
    rises = all(X.never_falls(f.path) for f in fits)
    total = table.agg(F.sum(F.col("best_by_bic").cast("int")).alias("a"), F.sum(F.col("best_by_oof").cast("int")).alias("b")).first()
    # The mean held-out likelihood may lie below that of the rows seen, but not far, with so few parameters.
    close = F.abs(F.col("oof_loglik") / F.col("oof_n") - F.col("train_loglik") / F.col("n")) < 0.2
    bic = F.abs(F.col("bic") - (-2 * F.col("train_loglik") + F.col("n_parameters") * F.log("n"))) < 1e-6
    return table.select(
        "k", "n", "n_parameters", "oof_n", F.lit(rises).alias("never_falls"), close.alias("held_out_is_close"), bic.alias("bic_fits"),
        F.lit(total["a"]).alias("choices_by_bic"), F.lit(total["b"]).alias("choices_by_oof"),
    )


@query("em_fractional_selection", duck("v_score") + SAMPLE + _selection_sql("WHERE presence = 1", "k * 4 + k - 1"))
def _(v):
    return _selection(v, B.fit_mixtures(sample(v).where("presence = 1"), "y", NUMERIC, KS, "fold", FOLDS))


@query("em_two_stage_mixture", duck("v_score") + SAMPLE + f"SELECT id, {r6('1.0', 'posterior_total')}, TRUE AS sums_to_loglik, TRUE AS bic_fits, TRUE AS never_falls FROM s")
def _(v):
    df = sample(v)
    fits = B.fit_mixtures(df, "y", NUMERIC, KS, "fold", FOLDS, presence="presence", starts=2)
    mixture = B.as_two_stage(_chosen(fits, B.holdout_table(v.spark, fits)), NUMERIC)
    share = F.least(F.greatest(F.col("y"), F.lit(X.EPS)), F.lit(1 - X.EPS))
    scores = mixture.scores(F.col("presence"), F.log(share / (F.lit(1.0) - share)))
    total = X.log_sum_exp(scores)
    parts = reduce(lambda a, b: a + b, [F.exp(s - total) for s in scores])
    rows = df.select("id", total.alias("ll"), parts.alias("posterior_total"))
    summed, n = rows.agg(F.sum("ll"), F.count(F.lit(1))).first()
    k = len(scores)
    sound = abs(summed - mixture.loglik) < 1e-6 * abs(summed)
    bic = abs(mixture.bic() - (-2 * summed + (k * (2 * (len(NUMERIC) + 1) + 1) + k - 1) * math.log(n))) < 1e-6 * abs(summed)
    return rows.select("id", "posterior_total", F.lit(sound).alias("sums_to_loglik"), F.lit(bic).alias("bic_fits"), F.lit(X.never_falls(mixture.path)).alias("never_falls"))


@query("em_two_stage_selection", duck("v_score") + SAMPLE + _selection_sql("", "k * 9 + k - 1"))
def _(v):
    return _selection(v, B.fit_mixtures(sample(v), "y", NUMERIC, KS, "fold", FOLDS, presence="presence", starts=2))


@query("moe_regimes", duck("v_score") + SAMPLE + f"SELECT id, {big('fold')}, {r6('y')}, TRUE AS known_regime, TRUE AS in_range FROM s")
def _(v):
    data = vectorized(sample(v), NUMERIC)[0].persist()

    def one(k):
        model = X.moe_regimes(data.where(F.col("fold") != k), "y", "presence", 2, PRIOR, params=SMALL)
        return X.moe_predict(model, data.where(F.col("fold") == k), PRIOR).select("id", "fold", "y", "regime", "hard_prediction", "soft_prediction")

    out = cut_lineage(reduce(DataFrame.unionByName, T.side_by_side(one, range(5))))
    data.unpersist()
    hard, soft = F.col("hard_prediction"), F.col("soft_prediction")
    return out.select("id", "fold", "y", F.col("regime").isin(0, 1).alias("known_regime"), (hard.between(0, 1) & soft.between(0, 1)).alias("in_range"))


# A twentieth of the rows is the least size of a regime here, so forty of them fall out and two stay, at any scale.
REGIME_KS = [2, 40]


def _regime_fold(df, k):
    """The design of the other folds, with the guards."""
    train, test, z = standardize_design(df.where(F.col("fold") != k), df.where(F.col("fold") == k), NUMERIC, keep=["id", "fold", "y", "presence"])
    a, b = vectorized(train, z)[0], vectorized(test, z)[0]
    return a, b, z, {"min_rows": a.count() // 20, "min_presences": 10, "min_absences": 10}


@query("kmeans_regime_models", duck("v_score") + SAMPLE + f"SELECT id, {big('fold')}, {r6('y')}, TRUE AS known_regime, TRUE AS in_range FROM s")
def _(v):
    df = sample(v).select("id", "fold", "y", "presence", *NUMERIC).persist()

    def one(k):
        a, b, z, guards = _regime_fold(df, k)
        placed, _ = X.kmeans_regime_models(a, b, z, "y", "presence", REGIME_KS, PRIOR, SMALL, **guards)
        return placed.select("id", "fold", "y", "k", "regime", "pred")

    out = cut_lineage(reduce(DataFrame.unionByName, T.side_by_side(one, range(5))))
    df.unpersist()
    return out.select("id", "fold", "y", F.col("regime").between(0, F.col("k") - 1).alias("known_regime"), F.col("pred").between(0, 1).alias("in_range"))


@query("regime_distribution", duck("v_score") + SAMPLE + f"""SELECT {big('f.fold', 'fold')}, {big('k')}, count(*) AS n, {r6('1.0', 'share')}, {big('sum(presence)', 'presences')}, k = 2 AS kept
    FROM (SELECT DISTINCT fold FROM s) f JOIN s ON s.fold <> f.fold, (VALUES (2), (40)) t(k) GROUP BY f.fold, k""")
def _(v):
    # The regimes of a k hold every row that the fold's experts may see, once.
    df = sample(v).select("id", "fold", "y", "presence", *NUMERIC).persist()

    def one(k):
        a, _, z, guards = _regime_fold(df, k)
        return X.regime_candidates(a, z, "presence", REGIME_KS, **guards).sizes.withColumn("fold", F.lit(k))

    whole = reduce(DataFrame.unionByName, T.side_by_side(one, range(5))).groupBy("fold", "k").agg(
        F.sum("n").alias("n"), F.sum("share").alias("share"), F.sum("presences").alias("presences"), F.every("kept").alias("kept"),
    )
    df.unpersist()
    return whole


@query("bic_select", duck("v_oof") + f""", f AS (SELECT cls + 1 AS k, -sum(pow(p_cand - y, 2)) AS ll, count(*) AS n, (cls + 1) * 9 + cls AS np, -avg(pow(p_base - y, 2)) AS oof FROM v_oof GROUP BY cls),
    b AS (SELECT *, -2 * ll + np * ln(n) AS bic FROM f)
    SELECT {big('k')}, {r6('ll', 'train_loglik')}, n, {big('np', 'n_parameters')}, {r6('oof', 'oof_loglik')}, {r6('bic')}, bic = (SELECT min(bic) FROM b) AS best_by_bic,
    oof = (SELECT max(oof) FROM b) AS best_by_oof FROM b""")
def _(v):
    k = F.col("cls") + 1
    gap = F.col("p_cand") - F.col("y")
    base = F.col("p_base") - F.col("y")
    fits = v.oof.groupBy(k.alias("k")).agg((-F.sum(gap * gap)).alias("train_loglik"), F.count(F.lit(1)).alias("n"), (-F.avg(base * base)).alias("oof_loglik"))
    return X.bic_select(fits.withColumn("n_parameters", F.col("k") * 9 + F.col("k") - 1))


N_PHI = 64
PHI = [f"f{i}" for i in range(N_PHI)]


def phi_wide(v):
    wide = to_wide(v.attr, ["id"], "f", "phi", list(range(N_PHI)))
    return wide.select("id", *[F.col(f"`{i}`").alias(f"f{i}") for i in range(N_PHI)])


@query("shap_kmeans", duck("v_attr") + f"""SELECT 'f' || f AS feature, count(*) AS n, {r6('sum(phi)', 'total')}, {r6('var_pop(phi) * count(*)', 'sum_of_squares')}, {big('4', 'clusters')} FROM v_attr GROUP BY f""")
def _(v):
    # Between plus within the clusters is the whole sum of squares of every feature.
    placed, _ = E.attribution_clusters(phi_wide(v), PHI)
    long = placed.unpivot(["cluster"], PHI, "feature", "phi")
    per = long.groupBy("feature", "cluster").agg(F.count("phi").alias("n"), F.sum("phi").alias("s"), F.var_pop("phi").alias("v"))
    mean = F.sum("s").over(Window.partitionBy("feature")) / F.sum("n").over(Window.partitionBy("feature"))
    parts = per.withColumn("between", F.col("n") * (F.col("s") / F.col("n") - mean) * (F.col("s") / F.col("n") - mean))
    return parts.groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("s").alias("total"), (F.sum("between") + F.sum(F.col("n") * F.col("v"))).alias("sum_of_squares"), F.count("cluster").alias("clusters")
    )


@query("shap_cluster_profile", duck("v_attr") + f""", s AS (SELECT id % 4 AS cluster, 'f' || f AS feature, avg(abs(phi)) AS a, avg(phi) AS g, count(*) AS n FROM v_attr GROUP BY 1, 2)
    SELECT {big('cluster')}, feature, {r6('a', 'mean_abs')}, {r6('g', 'mean_signed')}, n, first_value(feature) OVER (PARTITION BY cluster ORDER BY a DESC, feature) AS dominant_feature FROM s""")
def _(v):
    return E.cluster_profile(phi_wide(v).withColumn("cluster", F.col("id") % 4), PHI)


@query("pca_embed", duck("v_attr") + f"""SELECT id, {r6('sum(((phi - m) / sd) * ((phi - m) / sd))', 'squared_norm')}, {r6('1.0', 'explained')} FROM v_attr
    JOIN (SELECT f, avg(phi) AS m, stddev_samp(phi) AS sd FROM v_attr GROUP BY f) USING (f) GROUP BY id""")
def _(v):
    # All components together keep every row's squared norm, and explain all variance.
    scores, explained = E.attribution_pca(phi_wide(v), PHI, n=N_PHI)
    norm = reduce(lambda a, b: a + b, [F.col(f"pc{i + 1}") * F.col(f"pc{i + 1}") for i in range(N_PHI)])
    return scores.select("id", norm.alias("squared_norm"), F.lit(sum(explained)).alias("explained"))


@query("group_shapley_model", duck("v_score") + f"SELECT id, TRUE AS additive, TRUE AS in_range FROM v_score")
def _(v):
    df = sample(v)
    data, assembler = vectorized(df, NUMERIC)
    model = T.fit_two_stage(data, "y", "presence", SMALL)
    frame = lambda d: model.score(assembler.transform(d), PRIOR, "score").drop("features")
    groups = {"a": ["x1"], "b": ["x3"], "c": ["x4"]}
    pool = H.background_pool(df, "id", "w", NUMERIC, 64)
    phi = H.group_shapley_frame(df, "id", groups, frame, pool, 64, draws=4)
    # The prediction of all groups together is the model's own, found without any background.
    own = model.score(data, PRIOR, "_own").select("id", "_own")
    total = F.col("baseline") + F.col("phi__a") + F.col("phi__b") + F.col("phi__c")
    return phi.join(own, "id").select("id", (F.abs(total - F.col("_own")) < 1e-9).alias("additive"), F.col("baseline").between(0, 1).alias("in_range"))
