"""Windows, ranking, top-k, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.fixtures import duck
from gridspark.operators import crops as C
from gridspark.operators import metrics as M
from gridspark.operators import ranking as K
from gridspark.operators import summary as Y
from gridspark.operators.joins import region_join
from gridspark.operators.metrics import weighted_mean
from gridspark.queries.registry import big, bigs, query, r6

RC = bigs("r", "c")


@query("topk_mean", duck("v_crop_area") + f""", k AS (SELECT r, c, area_ha * yield_kg_ha / 1000 AS v, row_number() OVER (PARTITION BY r, c
    ORDER BY area_ha * yield_kg_ha / 1000 DESC, crop) AS n FROM v_crop_area WHERE yield_kg_ha > 0)
    SELECT {RC}, {r6('sum(v) / 5', 'top_mean')}, count(*) AS n_crops FROM k WHERE n <= 5 GROUP BY r, c""")
def _(v):
    valued = v.crop_area.withColumn("v", F.col("area_ha") * F.col("yield_kg_ha") / 1000)
    return C.topk_mean(valued, "v")


DOMINANT = """, k AS (SELECT r, c, crop, area_ha, sum(area_ha) OVER (PARTITION BY r, c) AS tot, row_number() OVER (PARTITION BY r, c ORDER BY area_ha DESC, crop) AS n
    FROM v_crop_area WHERE area_ha > 0), d AS (SELECT * FROM k WHERE n = 1)"""


@query("dominant_crop", duck("v_crop_area") + DOMINANT + f"SELECT {RC}, crop AS dominant, {r6('area_ha / tot', 'dominant_share')} FROM d")
def _(v):
    return C.dominant_crop(v.crop_area)


@query("dominance_counts", duck("v_crop_area") + DOMINANT + f"SELECT crop AS dominant, count(*) AS n_cells, {r6('count(*) / (SELECT count(*) FROM d)', 'share')} FROM d GROUP BY crop")
def _(v):
    return C.dominance_counts(C.dominant_crop(v.crop_area))


# Four candidate models blended from the two predictions.
MODELS = [("m0", 0.0), ("m1", 0.3), ("m2", 0.6), ("m3", 1.0)]
BLENDED = """, b AS (SELECT lat, lon, y, model, p_base + share * (p_cand - p_base) AS p, nf FROM v_oof,
    (VALUES ('m0', 0.0, 5), ('m1', 0.3, 4), ('m2', 0.6, 3), ('m3', 1.0, 6)) AS t(model, share, nf)),
    reg AS (SELECT region, model, sqrt(avg((p - y) * (p - y))) AS rmse, 1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2
      FROM b JOIN v_regions ON lat BETWEEN s_lat AND n_lat AND lon BETWEEN w_lon AND e_lon GROUP BY region, model)"""


def blended(v, keep):
    inside = region_join(v.oof, v.regions) if "region" in keep else v.oof
    models = F.array(*[
        F.struct(F.lit(m).alias("model"), (F.col("p_base") + F.lit(s) * (F.col("p_cand") - F.col("p_base"))).alias("p")) for m, s in MODELS
    ])
    return inside.select(*keep, "y", F.explode(models).alias("m")).select(*keep, "y", "m.model", "m.p")


@query("rank_within_region", duck("v_oof", "v_regions") + BLENDED + f"""SELECT region, model, {r6('rmse')},
    row_number() OVER (PARTITION BY region ORDER BY rmse, model) AS rank FROM reg""")
def _(v):
    metrics = M.regression_metrics(blended(v, ["region"]), "y", "p", by=["region", "model"]).select("region", "model", "rmse")
    return K.rank_within(metrics, ["region"], "rmse", ["model"])


CLASSED = """, c AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY rmse, model) AS rank,
    CASE WHEN rmse < 0.24 THEN 'clear_improvement' WHEN rmse < 0.29 THEN 'likely_improvement' ELSE 'no_improvement' END AS improvement_class
    FROM reg WHERE model < CASE region WHEN 'mid' THEN 'm1' WHEN 'isle' THEN 'm2' ELSE 'm9' END)"""


@query("best_variant_recommend", duck("v_oof", "v_regions") + BLENDED + CLASSED + """SELECT region, CASE WHEN improvement_class <> 'no_improvement' THEN model
    ELSE 'baseline' END AS recommended, model AS closest_candidate, improvement_class FROM c WHERE rank = 1""")
def _(v):
    metrics = M.regression_metrics(blended(v, ["region"]), "y", "p", by=["region", "model"])
    limit = F.when(F.col("region") == "mid", "m1").when(F.col("region") == "isle", "m2").otherwise("m9")
    label = F.when(F.col("rmse") < 0.24, "clear_improvement").when(F.col("rmse") < 0.29, "likely_improvement").otherwise("no_improvement")
    ranking = K.rank_within(metrics.where(F.col("model") < limit).withColumn("improvement_class", label), ["region"], "rmse", ["model"])
    return K.recommend_variant(ranking, "region")


@query("parsimonious_pick", duck("v_oof", "v_regions") + BLENDED + f""", g AS (SELECT model, any_value(nf) AS n_features, sqrt(avg((p - y) * (p - y))) AS rmse,
      1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM b GROUP BY model)
    SELECT model, {big('n_features')}, {r6('rmse')}, {r6('r2')} FROM g WHERE r2 >= (SELECT max(r2) FROM g) - 0.5 ORDER BY n_features, rmse LIMIT 1""")
def _(v):
    features = F.element_at(F.create_map(*[F.lit(x) for pair in (("m0", 5), ("m1", 4), ("m2", 3), ("m3", 6)) for x in pair]), F.col("model"))
    metrics = M.regression_metrics(blended(v, []), "y", "p", by=["model"]).withColumn("n_features", features)
    return K.parsimonious_pick(metrics, tol=0.5).select("model", "n_features", "rmse", "r2")


IMPORTANCE = ", i AS (SELECT cls AS stage, f AS feature, sum(abs(phi)) AS gain FROM v_attr GROUP BY cls, f)"


def importance(v):
    return v.attr.groupBy(F.col("cls").alias("stage"), F.col("f").alias("feature")).agg(F.sum(F.abs("phi")).alias("gain"))


@query("importance_share", duck("v_attr") + IMPORTANCE + f"SELECT {bigs('stage', 'feature')}, {r6('gain')}, {r6('gain / sum(gain) OVER (PARTITION BY stage)', 'share')} FROM i")
def _(v):
    return K.share_within(importance(v), "gain", ["stage"])


@query("importance_rank", duck("v_attr") + IMPORTANCE + f"SELECT {bigs('stage', 'feature')}, {r6('gain')}, row_number() OVER (ORDER BY gain DESC, stage, feature) AS rank FROM i")
def _(v):
    return K.ranked(importance(v), "gain", ["stage", "feature"])


@query("topn_per_group", duck("v_attr") + IMPORTANCE + f"""SELECT {bigs('stage', 'feature')}, {r6('gain')}, rank FROM (SELECT *, row_number() OVER (PARTITION BY stage
    ORDER BY gain DESC, feature) AS rank FROM i) WHERE rank <= 5""")
def _(v):
    return K.topn_per_group(importance(v), ["stage"], [F.desc("gain"), F.col("feature")], 5)


@query("top_n", duck("v_attr") + IMPORTANCE + f"SELECT {bigs('stage', 'feature')}, {r6('gain')} FROM i ORDER BY gain DESC, stage, feature LIMIT 20")
def _(v):
    return K.top_n(importance(v), [F.desc("gain"), F.col("stage"), F.col("feature")], 20)


def edges_sql(n: int, x: str) -> str:
    return f"list_distinct([{', '.join(f'quantile_cont({x}, {i / n})' for i in range(n + 1))}])"


@query("quantile_bins", duck("v_oof") + f""", e AS (SELECT {edges_sql(20, 'p_cand')} AS e FROM v_oof), k AS (SELECT greatest(len(list_filter(e, lambda q: q < p_cand)) - 1, 0) AS bin,
    p_cand, y, w FROM v_oof, e) SELECT {big('bin')}, count(*) AS n, {r6('sum(w * p_cand) / sum(w)', 'x')}, {r6('sum(w * y) / sum(w)', 'y')} FROM k GROUP BY bin""")
def _(v):
    binned = K.quantile_bins(v.oof, "p_cand", 20)
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), weighted_mean(F.col("p_cand"), F.col("w")).alias("x"), weighted_mean(F.col("y"), F.col("w")).alias("y")
    )


@query("union_rows", duck("v_oof") + f"SELECT part, count(*) AS n, {r6('sum(y)', 'total')} FROM (SELECT 'a' AS part, y FROM v_oof WHERE cls < 2 UNION ALL SELECT 'b', y FROM v_oof WHERE cls >= 1) GROUP BY part")
def _(v):
    oof = v.oof
    a = oof.where("cls < 2").select(F.lit("a").alias("part"), "y")
    b = oof.where("cls >= 1").select("y", F.lit("b").alias("part"))
    return a.unionByName(b).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))


@query("dedupe", duck("v_oof") + f"SELECT {RC}, id, {r6('y')} FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY id, y) AS k FROM v_oof) WHERE k = 1")
def _(v):
    return K.dedupe(v.oof.select("r", "c", "id", "y"), ["r", "c"], ["id", "y"])


@query("wide_to_long", duck("v_cells") + f"SELECT {RC}, 'frac' AS feature, {r6('frac', 'x')} FROM v_cells UNION ALL SELECT {RC}, 'pop', {r6('pop', 'x')} FROM v_cells")
def _(v):
    return Y.to_long(v.cells, ["frac", "pop"], ["r", "c"])


@query("long_to_wide", duck("v_attr") + f"SELECT id, {', '.join(r6(f'max(phi) FILTER (WHERE f = {i})', str(i)).replace(f'AS {i}', f'AS f{i}') for i in range(64))} FROM v_attr GROUP BY id")
def _(v):
    wide = Y.to_wide(v.attr, ["id"], "f", "phi", list(range(64)))
    return wide.select("id", *[F.col(f"`{i}`").alias(f"f{i}") for i in range(64)])


@query("set_checks", """WITH a AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size > 3), b AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_retailprice < 1200
    UNION SELECT DISTINCT p_type FROM part)
    SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'missing' WHEN a.name IS NULL THEN 'unexpected' ELSE 'present' END AS status
    FROM a FULL JOIN b ON a.name = b.name""")
def _(v):
    part = v.table("part")
    a = part.where("p_size > 3").select(F.col("p_brand").alias("name"))
    b = part.where("p_retailprice < 1200").select(F.col("p_brand").alias("name")).unionByName(part.select(F.col("p_type").alias("name")))
    return K.set_checks(a, b, "name")
