"""Samples, folds, weights, imputation, bootstrap and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.fixtures import CELLS, duck
from gridspark.functions import scalar as S
from gridspark.functions.rng import key_hash
from gridspark.operators import metrics as M
from gridspark.operators import resample as B
from gridspark.operators import sampling as P
from gridspark.operators.joins import region_join
from gridspark.queries.registry import big, bigs, query, r6

RC = bigs("r", "c")


def hash_sql(key: str, *salts) -> str:
    """The portable hash as SQL text."""
    parts = ", ".join(f"CAST(CAST({x} AS BIGINT) AS VARCHAR)" for x in (key, *salts))
    return f"CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 15) AS BIGINT)"


def uniform_sql(h: str) -> str:
    return f"(({h} // 256 + 0.5) / CAST(4503599627370496.0 AS DOUBLE))"


CELL_ID = ", x AS (SELECT *, r * 72 + c AS id, CASE WHEN frac > 0.5 THEN 1 ELSE 0 END AS presence FROM v_cells)"


def keyed(v):
    return v.cells.select("*", (F.col("r") * 72 + F.col("c")).alias("id"), (F.col("frac") > 0.5).cast("int").alias("presence"))


CASE_CONTROL = CELL_ID + f""", s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY presence ORDER BY {hash_sql('id', 42)}, id) AS k FROM x)
    WHERE k <= CASE WHEN presence = 1 THEN 200 ELSE 150 END)"""


@query("case_control_sample", duck("v_cells") + CASE_CONTROL + f"SELECT id, {big('presence')}, k AS sample_rank FROM s")
def _(v):
    return P.case_control_sample(keyed(v), "id", "presence", 200, 150).select("id", "presence", "sample_rank")


@query("uniform_sample", duck("v_score") + f"SELECT id, {r6('x1')} FROM v_score ORDER BY {hash_sql('id', 7)}, id LIMIT 1000")
def _(v):
    return P.uniform_sample(v.score, "id", 1000, seed=7).select("id", "x1")


@query("weighted_sample", duck("v_score") + f"""SELECT id, w FROM v_score WHERE w > 0
    ORDER BY -round(ln(w) - ln(-ln({uniform_sql(hash_sql('id', 42))})), 9), id LIMIT 500""")
def _(v):
    return P.weighted_sample(v.score, "id", "w", 500).select("id", "w")


@query("weighted_bootstrap_draw", duck("v_score") + f""", p AS (SELECT id, w, sum(w) OVER (ORDER BY id) AS e, sum(w) OVER () AS t FROM v_score),
    d AS (SELECT i AS draw, {uniform_sql(hash_sql('i', 42))} AS u FROM range(300) t(i))
    SELECT draw, id FROM d JOIN p ON (e - w) / t <= u AND u < e / t""")
def _(v):
    return P.weighted_draw(v.score, "id", "w", 300)


@query("group_kfold", duck("v_oof").replace("WITH ", "WITH RECURSIVE ", 1) + f""", g AS (SELECT block, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, block) AS k FROM v_oof GROUP BY block),
    a AS (SELECT 0 AS k, CAST(-1 AS BIGINT) AS block, -1 AS fold, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS loads
      UNION ALL SELECT g.k, g.block, list_position(a.loads, list_min(a.loads)) - 1,
        [CASE WHEN i = list_position(a.loads, list_min(a.loads)) THEN a.loads[i] + g.n ELSE a.loads[i] END for i in [1, 2, 3, 4, 5]]
      FROM a JOIN g ON g.k = a.k + 1)
    SELECT {bigs('block', 'fold')} FROM a WHERE k > 0""")
def _(v):
    return P.group_kfold(v.oof, "block")


@query("group_fold_variant", duck("v_oof") + f"SELECT {big('block % 5', 'fold')}, count(*) AS n, count(DISTINCT block) AS blocks FROM v_oof GROUP BY 1")
def _(v):
    return v.oof.groupBy((F.col("block") % 5).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("block").alias("blocks"))


@query("group_shuffle_split", duck("v_oof") + f""", g AS (SELECT DISTINCT block FROM v_oof)
    SELECT {big('block')}, row_number() OVER (ORDER BY {hash_sql('block', 42)}, block) <= ceil((SELECT count(*) FROM g) * 0.25) AS is_test FROM g""")
def _(v):
    return P.group_shuffle_split(v.oof, "block")


MASK = "pop >= 0 AND excl BETWEEN 1 AND 6 AND excl <> 5 AND soil BETWEEN 1 AND 33"


@query("target_prior", duck("v_cells") + f"SELECT {r6('avg(CASE WHEN frac > 0.5 THEN 1.0 ELSE 0.0 END)', 'prior')}, count(*) AS n_eligible FROM v_cells WHERE {MASK}")
def _(v):
    mask = S.land_mask(F.col("pot_rain"), F.col("frac"), F.col("pop"), F.col("excl"), F.col("soil"))
    return P.target_prior(v.cells, mask, S.presence_flag(F.col("frac"), 0.5))


@query("area_weight", duck("v_cells") + CASE_CONTROL + f""", n AS (SELECT presence, count(*) AS n FROM x GROUP BY 1), m AS (SELECT presence, count(*) AS m FROM s GROUP BY 1)
    SELECT id, {r6('n / m * pow(6371.0088, 2) * radians(5.0) * (sin(radians(90 - r * 5.0)) - sin(radians(90 - (r + 1) * 5.0))) / 1000', 'weight')}
    FROM s JOIN n USING (presence) JOIN m USING (presence)""")
def _(v):
    cells = keyed(v).withColumn("area", CELLS.area(F.col("r")) / 1000)
    sample = P.case_control_sample(cells, "id", "presence", 200, 150)
    return P.area_weight(sample, cells, "presence", "area").select("id", "weight")


@query("normalize_weight", duck("v_score") + f"SELECT id, {r6('w / (SELECT avg(w) FROM v_score)', 'w')} FROM v_score")
def _(v):
    return P.normalize_weight(v.score, "w").select("id", "w")


@query("selection_reweight", duck("v_score") + f""", k AS (SELECT fold, avg(CASE WHEN {hash_sql('id', 5)} % 4 = 0 THEN 1.0 ELSE 0.0 END) AS rate FROM v_score GROUP BY fold)
    SELECT id, {r6('w / rate', 'w')} FROM v_score JOIN k USING (fold) WHERE {hash_sql('id', 5)} % 4 = 0""")
def _(v):
    return P.selection_reweight(v.score, key_hash(F.col("id"), 5) % 4 == 0, "w", ["fold"]).select("id", "w")


@query("regime_prior", duck("v_oof") + f"""SELECT {big('cls')}, {r6('CASE WHEN cls = 3 THEN avg(presence) ELSE sum(w * presence) / sum(w) END', 'prior')}, count(*) AS n
    FROM v_oof GROUP BY cls""")
def _(v):
    # Regime 3 has no valid weight and falls back to the plain share.
    train = v.oof.withColumn("w", F.when(F.col("cls") != 3, F.col("w")))
    return P.regime_prior(train, "cls", "presence", "w")


HOLES = ", d AS (SELECT r, c, CASE WHEN (r + c) % 7 <> 0 THEN pot_rain END AS x FROM v_cells)"


def holes(v):
    return v.cells.select("r", "c", F.when((F.col("r") + F.col("c")) % 7 != 0, F.col("pot_rain")).alias("x"))


@query("median_impute", duck("v_cells") + HOLES + f"SELECT {RC}, {r6('coalesce(x, (SELECT median(x) FROM d))', 'x')}, {big('CASE WHEN x IS NULL THEN 1 ELSE 0 END', 'imputed')} FROM d")
def _(v):
    return P.median_impute(holes(v), "x")


@query("zero_impute", duck("v_cells") + HOLES + f"SELECT {RC}, {r6('coalesce(x, 0)', 'x')} FROM d")
def _(v):
    return P.zero_impute(holes(v), "x")


def bootstrap_sql(by: str, source: str, reps: int) -> str:
    """Bootstrap of 'cand_vs_base' over the blocks of ``source``."""
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON TRUE"
    h = hash_sql("ix - 1", 42, "rep")
    return f""", st AS (SELECT {b}block, count(*) AS n, sum((y - p_cand) * (y - p_cand)) AS a, sum((y - p_base) * (y - p_base)) AS z FROM {source} GROUP BY {b}block),
    nb AS (SELECT *, row_number() OVER ({part} ORDER BY block) AS ix, count(*) OVER ({part}) AS nn FROM st),
    dr AS (SELECT {b}rep, CAST(floor({uniform_sql(h)} * nn) AS BIGINT) + 1 AS pick FROM nb, range({reps}) t(rep)),
    rp AS (SELECT {'dr.' + by + ', ' if by else ''}rep, sqrt(sum(a) / sum(n)) - sqrt(sum(z) / sum(n)) AS d FROM dr JOIN nb ON pick = ix {'AND dr.' + by + ' = nb.' + by if by else ''} GROUP BY ALL),
    bo AS (SELECT {b}avg(d) AS m, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END) AS p FROM rp {'GROUP BY ' + by if by else ''}),
    pt AS (SELECT {b}sqrt(sum(a) / sum(n)) - sqrt(sum(z) / sum(n)) AS d, count(*) AS nblocks FROM st {'GROUP BY ' + by if by else ''})
    SELECT {b}'cand_vs_base' AS contrast, {r6('m', 'bootstrap_mean_delta')}, {r6('lo', 'ci_low')}, {r6('hi', 'ci_high')}, {r6('p', 'probability_lower_rmse')},
    nblocks AS n_blocks, {r6('pt.d', 'delta_rmse')} FROM bo JOIN pt {using}"""


CONTRAST = {"cand_vs_base": ("p_cand", "p_base")}


@query("block_bootstrap", duck("v_oof") + bootstrap_sql("", "v_oof", 2000))
def _(v):
    return B.block_bootstrap(v.oof, "y", CONTRAST, "block", reps=2000)


IN_REGION = ", inr AS (SELECT region, block, y, p_cand, p_base FROM v_oof JOIN v_regions ON lat BETWEEN s_lat AND n_lat AND lon BETWEEN w_lon AND e_lon)"


@query("block_bootstrap_regional", duck("v_oof", "v_regions") + IN_REGION + bootstrap_sql("region", "inr", 2000))
def _(v):
    return B.block_bootstrap(region_join(v.oof, v.regions), "y", CONTRAST, "block", reps=2000, by=["region"])


CLASSES = """, k AS (SELECT block, avg(abs(p_cand - y)) AS a, avg(abs(p_base - y)) AS b, avg(presence) AS p FROM v_oof GROUP BY block)"""


@query("improvement_class", duck("v_oof") + CLASSES + f"""SELECT {big('block')}, CASE WHEN block % 9 = 0 THEN 'reference' WHEN a - b + 0.05 < 0 THEN 'clear_improvement'
    WHEN p >= 0.8 THEN 'likely_improvement' WHEN a < b THEN 'point_estimate_improvement' ELSE 'no_improvement' END AS improvement_class FROM k""")
def _(v):
    k = v.oof.groupBy("block").agg(
        F.avg(F.abs(F.col("p_cand") - F.col("y"))).alias("a"), F.avg(F.abs(F.col("p_base") - F.col("y"))).alias("b"), F.avg("presence").alias("p")
    )
    label = B.improvement_class(F.col("block") % 9 == 0, F.col("a") - F.col("b") + 0.05, F.col("p"), F.col("a") < F.col("b"))
    return k.select("block", label.alias("improvement_class"))


# Gains of seven tested models per region, read off parts of the data.
TESTED = ("add_depth", "add_recharge", "add_flow", "add_both", "river_1", "river_01", "baseline")
REGIONAL = """, reg AS (SELECT CASE cls WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END AS region,
    CASE id % 7 WHEN 0 THEN 'add_depth' WHEN 1 THEN 'add_recharge' WHEN 2 THEN 'add_flow' WHEN 3 THEN 'add_both' WHEN 4 THEN 'river_1' WHEN 5 THEN 'river_01' ELSE 'baseline' END AS model,
    avg(abs(p_base - y) - abs(p_cand - y)) - 0.19 AS gain FROM v_oof GROUP BY 1, 2),
    m AS (SELECT model, avg(gain) AS g, count(*) FILTER (WHERE gain > 0) AS wins FROM reg GROUP BY model)"""


def regional_gains(v):
    model = F.element_at(F.array(*[F.lit(t) for t in TESTED]), (F.col("id") % 7).cast("int") + 1)
    region = F.element_at(F.array(*[F.lit(t) for t in "abcd"]), (F.col("cls")).cast("int") + 1)
    gain = F.avg(F.abs(F.col("p_base") - F.col("y")) - F.abs(F.col("p_cand") - F.col("y"))) - 0.19
    return v.oof.groupBy(region.alias("region"), model.alias("model")).agg(gain.alias("rmse_improvement_vs_baseline")).withColumn(
        "rmse_improved", F.col("rmse_improvement_vs_baseline") > 0
    )


@query("forward_select_rule", duck("v_oof") + REGIONAL + """, o AS (SELECT max(g) FILTER (WHERE model = 'add_depth' AND g > 0 AND wins >= 2) IS NOT NULL AS d,
    max(g) FILTER (WHERE model = 'add_recharge' AND g > 0 AND wins >= 2) IS NOT NULL AS r, max(g) FILTER (WHERE model = 'add_flow' AND g > 0 AND wins >= 2) IS NOT NULL AS f,
    coalesce(max(g) FILTER (WHERE model = 'add_both' AND g > 0 AND wins >= 2) > max(g) FILTER (WHERE model IN ('add_depth', 'add_recharge')), FALSE) AS b FROM m),
    rv AS (SELECT model, g FROM m WHERE model LIKE 'river%' ORDER BY g DESC, model DESC LIMIT 1)
    SELECT CASE WHEN rv.g > 0 THEN rv.model ELSE 'baseline' END AS selected_variant,
    concat_ws('|', CASE WHEN d OR b THEN 'depth' END, CASE WHEN r OR b THEN 'recharge' END, CASE WHEN f THEN 'flow' END) AS selected_additions FROM o, rv""")
def _(v):
    additions = {"add_depth": "depth", "add_recharge": "recharge", "add_flow": "flow"}
    return B.forward_select(regional_gains(v), additions, ("add_both", ["depth", "recharge"]), ["river_1", "river_01"])


@query("evidence_gated_select", duck("v_oof") + """, k AS (SELECT 't' || cls || CASE WHEN presence = 1 THEN '_wx' ELSE '' END AS model, sqrt(avg((p_cand - y) * (p_cand - y))) AS rmse FROM v_oof GROUP BY 1),
    h AS (SELECT 'c' || cls AS contrast, avg(p_cand - p_base) - 0.07 AS hi FROM v_oof GROUP BY 1),
    a AS (SELECT 't0' AS m, (SELECT rmse FROM k WHERE model = 't0') AS e),
    b AS (SELECT CASE WHEN (SELECT rmse FROM k WHERE model = 't1') < e AND (SELECT hi FROM h WHERE contrast = 'c1') < 0 THEN 't1' ELSE m END AS m FROM a),
    c AS (SELECT CASE WHEN (SELECT rmse FROM k WHERE model = 't2') < (SELECT rmse FROM k WHERE model = b.m) AND (SELECT hi FROM h WHERE contrast = 'c2') < 0 THEN 't2' ELSE m END AS m FROM b),
    x AS (SELECT m, coalesce((SELECT rmse FROM k WHERE model = c.m || '_wx') < (SELECT rmse FROM k WHERE model = c.m) AND (SELECT hi FROM h WHERE contrast = 'c3') < 0, FALSE) AS extended FROM c)
    SELECT m AS choice, extended, CASE WHEN extended THEN m || '_wx' ELSE m END AS selected_model FROM x""")
def _(v):
    model = F.concat(F.lit("t"), F.col("cls").cast("string"), F.when(F.col("presence") == 1, "_wx").otherwise(""))
    metrics = M.regression_metrics(v.oof.withColumn("model", model), "y", "p_cand", by=["model"])
    boot = v.oof.groupBy(F.concat(F.lit("c"), F.col("cls").cast("string")).alias("contrast")).agg((F.avg(F.col("p_cand") - F.col("p_base")) - 0.07).alias("ci_high"))
    return B.evidence_select(
        metrics, boot, ("t0", "t0"), [("t1", "t1", "c1"), ("t2", "t2", "c2")], {t: (f"{t}_wx", "c3") for t in ("t0", "t1", "t2")}
    )
