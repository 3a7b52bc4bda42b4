"""Aggregations and model metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.fixtures import duck
from gridspark.operators import crops as C
from gridspark.operators import metrics as M
from gridspark.operators import reference as P
from gridspark.operators import summary as Y
from gridspark.operators.joins import region_join
from gridspark.queries.registry import big, bigs, query, r6, r6s

RC = bigs("r", "c")


def rows():
    return F.count(F.lit(1))



@query("price_summary", duck("v_prices") + f""", x AS (SELECT * FROM v_prices WHERE element = 'Producer Price (USD/tonne)' AND months = 'Annual value' AND val > 0)
    SELECT item, {r6('avg(val)', 'price_mean')}, {r6('median(val)', 'price_median')}, count(*) AS observations, count(DISTINCT area) AS countries,
    {big('min(yr)', 'min_year')}, {big('max(yr)', 'max_year')} FROM x WHERE yr > (SELECT max(yr) FROM x) - 5 GROUP BY item""")
def _(v):
    return P.price_summary(v.prices)


@query("calorie_summary", duck("v_fbs") + f""", x AS (SELECT * FROM v_fbs WHERE area = 'World' OR NOT EXISTS (SELECT 1 FROM v_fbs WHERE area = 'World')),
    w AS (SELECT area, item, yr, avg(val) FILTER (WHERE element LIKE '%quantity%') AS q, avg(val) FILTER (WHERE element LIKE '%kcal%') AS e FROM x
      WHERE yr > (SELECT max(yr) FROM x) - 5 GROUP BY area, item, yr),
    k AS (SELECT item, yr, e * 365.0 / q AS kcal FROM w WHERE q > 0)
    SELECT item, {r6('avg(kcal)', 'kcal_mean')}, {r6('median(kcal)', 'kcal_median')}, count(*) AS observations, {big('min(yr)', 'min_year')},
    {big('max(yr)', 'max_year')} FROM k WHERE kcal > 0 AND kcal < 10000 GROUP BY item""")
def _(v):
    return P.calorie_summary(v.fbs)


# Crop cells in zones of grid columns, with the cropped share of the cell.
ZONED = """, z AS (SELECT a.c % 25 AS zone, area_ha, yield_kg_ha / 1000 AS yld, frac AS share FROM v_crop_area a LEFT JOIN v_cells USING (r, c)),
    s AS (SELECT zone, sum(area_ha) AS area, sum(area_ha * yld / 1000) AS prod, sum(area_ha * coalesce(share, 0)) AS carea,
      sum(area_ha * coalesce(share, 0) * yld / 1000) AS cprod, count(*) AS n FROM z GROUP BY zone)"""


def zoned(v):
    joined = v.crop_area.join(v.cells.select("r", "c", F.col("frac").alias("share")), ["r", "c"], "left")
    return joined.select((F.col("c") % 25).alias("zone"), "area_ha", (F.col("yield_kg_ha") / 1000).alias("yld"), "share")


@query("country_summary", duck("v_crop_area", "v_cells") + ZONED + f"""SELECT {big('zone')}, {r6('area', 'area_ha')}, {r6('prod', 'production_t')},
    {r6('carea', 'cropped_area_ha')}, {r6('cprod', 'cropped_production_t')}, n AS n_cells, {r6('prod * 1000 / area', 'mean_yield_kg_ha')},
    {r6('cprod * 1000 / carea', 'cropped_mean_yield_kg_ha')} FROM s""")
def _(v):
    return P.zone_summary(zoned(v), "zone", "area_ha", "yld", "share")


@query("stage_reduction", duck("v_crop_area", "v_cells") + ZONED + f""", t AS (SELECT CAST(zone AS VARCHAR) AS zone, area AS a, prod AS b, cprod AS d FROM s
      UNION ALL SELECT 'TOTAL', sum(area), sum(prod), sum(cprod) FROM s)
    SELECT zone, {r6('b / a', 'attainable_share')}, {r6('d / b', 'adjusted_share_of_attainable')}, {r6('d / a', 'adjusted_share')},
    {r6('(a - b) * 100 / a', 'climate_loss_pct')}, {r6('(b - d) * 100 / b', 'cropland_loss_pct')}, {r6('(a - d) * 100 / a', 'total_loss_pct')} FROM t""")
def _(v):
    stages = P.zone_summary(zoned(v), "zone", "area_ha", "yld", "share")
    return P.stage_reduction(stages, "zone", "area_ha", "production_t", "cropped_production_t").drop("area_ha", "production_t", "cropped_production_t")


ACTUAL = """, o AS (SELECT c_nationkey AS zone, sum(c_acctbal) AS actual FROM customer GROUP BY 1),
    j AS (SELECT s.zone, prod, actual, actual / prod AS ratio, log10(prod) AS lp, log10(actual) AS la,
      CASE s.zone WHEN 7 THEN 'Europe' ELSE 'R' || (s.zone % 5) END AS region FROM s JOIN o USING (zone) WHERE prod > 0 AND actual > 0)"""


def potential(v):
    zones = P.zone_summary(zoned(v), "zone", "area_ha", "yld", "share").select(
        F.col("zone").cast("string").alias("zone"), "production_t", F.concat(F.lit("R"), (F.col("zone") % 5).cast("string")).alias("region")
    )
    actual = v.table("customer").groupBy(F.col("c_nationkey").cast("string").alias("zone")).agg(F.sum("c_acctbal").alias("actual"))
    return P.potential_vs_actual(zones, actual, "zone", "production_t", "actual", "region", {"7": "Europe"})


@query("potential_vs_actual", duck("v_crop_area", "v_cells") + ZONED + ACTUAL + f"""SELECT CAST(zone AS VARCHAR) AS zone, region, {r6('ratio')},
    {r6('lp', 'log10_potential')}, {r6('la', 'log10_actual')} FROM j""")
def _(v):
    return potential(v).select("zone", "region", "ratio", "log10_potential", "log10_actual")


@query("pearson_corr", duck("v_crop_area", "v_cells") + ZONED + ACTUAL + f"SELECT count(*) AS n, {r6('corr(prod, actual)', 'r_raw')}, {r6('corr(lp, la)', 'r_log10')} FROM j")
def _(v):
    return potential(v).agg(rows().alias("n"), F.corr("production_t", "actual").alias("r_raw"), F.corr("log10_potential", "log10_actual").alias("r_log10"))


RANKS = """, x AS (SELECT cls, y, p_cand, w FROM v_oof),
    k AS (SELECT cls, {0} FROM x)"""


def _avg_rank(col: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, {col}" if part else f"PARTITION BY {col}"
    return f"rank() OVER ({p}ORDER BY {col}) + (count(*) OVER ({q}) - 1) / 2.0"


@query("spearman_corr", duck("v_oof") + RANKS.format(f"{_avg_rank('y', 'cls')} AS ry, {_avg_rank('p_cand', 'cls')} AS rp")
       + f"SELECT {big('cls')}, {r6('corr(ry, rp)', 'spearman')} FROM k GROUP BY cls")
def _(v):
    return M.spearman(v.oof, "y", "p_cand", ["cls"])


@query("spearman_matrix", duck("v_cells") + f""", k AS (SELECT {_avg_rank('frac')} AS a, {_avg_rank('pot_rain')} AS b, {_avg_rank('pop')} AS d FROM v_cells),
    m AS (SELECT corr(a, b) AS ab, corr(a, d) AS ad, corr(b, d) AS bd FROM k)
    SELECT x AS a, y AS b, {r6('''CASE WHEN x = y THEN 1.0 WHEN x || y IN ('fracpot_rain', 'pot_rainfrac') THEN ab WHEN x || y IN ('fracpop', 'popfrac') THEN ad
    ELSE bd END''', 'spearman')} FROM m, (VALUES ('frac'), ('pot_rain'), ('pop')) p(x), (VALUES ('frac'), ('pot_rain'), ('pop')) q(y)""")
def _(v):
    return M.spearman_matrix(v.cells, ["frac", "pot_rain", "pop"])


# The p-value by its finite series in the angle atan(t / sqrt(df)), one way for even and one for odd degrees of freedom.
P_SERIES = """, q AS (SELECT *, n - 2 AS df, atan(abs(t) / sqrt(n - 2)) AS th FROM tt),
    i AS (SELECT grp, j, df, th, CASE WHEN df % 2 = 0 THEN (2 * j - 1) / (2.0 * j) ELSE 2.0 * j / (2 * j + 1) END AS f FROM q, range(1, 20000) z(j) WHERE j <= (df - 2) // 2 AND j < 20000),
    c AS (SELECT grp, j, df, th, exp(sum(ln(f)) OVER (PARTITION BY grp ORDER BY j)) AS c FROM i),
    sums AS (SELECT grp, sum(CASE WHEN df % 2 = 0 THEN c * pow(cos(th), 2 * j) WHEN j <= (df - 3) // 2 THEN c * pow(cos(th), 2 * j + 1) ELSE 0 END) AS s FROM c GROUP BY grp),
    pv AS (SELECT q.*, 1 - CASE WHEN df % 2 = 0 THEN sin(th) * (1 + coalesce(s, 0)) ELSE 2 / pi() * (th + CASE WHEN df > 1 THEN sin(th) * (cos(th) + coalesce(s, 0)) ELSE 0 END) END AS p FROM q LEFT JOIN sums USING (grp))"""


@query("corr_pvalue", duck("v_cells") + f""", k AS (SELECT soil % 4 AS grp, count(*) AS n, corr(frac, pot_rain) AS r FROM v_cells GROUP BY 1),
    tt AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM k)""" + P_SERIES + f" SELECT {big('grp')}, n, {r6('r')}, {r6('t')}, {r6('p')} FROM pv")
def _(v):
    k = v.cells.groupBy((F.col("soil") % 4).alias("grp")).agg(rows().alias("n"), F.corr("frac", "pot_rain").alias("r"))
    return k.withColumn("t", M.corr_t(F.col("r"), F.col("n"))).withColumn("p", M.correlation_p(F.col("t"), F.col("n")))


@query("crop_share", duck("v_crop_area", "v_cells") + f"""SELECT {RC}, crop, {r6('area_ha / sum(area_ha) OVER (PARTITION BY r, c)', 'share')},
    {r6('CASE WHEN pop > 0 THEN area_ha / pop ELSE 0 END', 'cropland_share')} FROM v_crop_area LEFT JOIN v_cells USING (r, c)""")
def _(v):
    joined = v.crop_area.join(v.cells.select("r", "c", "pop"), ["r", "c"], "left")
    return C.crop_share(joined, cropland="pop").select("r", "c", "crop", "share", "cropland_share")


SYSTEMS = """, x AS (SELECT l_partkey % 36 AS r, l_orderkey % 72 AS c, p_brand AS crop, CASE WHEN l_returnflag = 'A' THEN 'A' WHEN l_returnflag = 'N' THEN 'I' ELSE 'R' END
    AS production_system, l_quantity AS area_ha FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("total_area", f"""WITH z AS (SELECT 1){SYSTEMS},
    k AS (SELECT r, c, crop, sum(area_ha) FILTER (WHERE production_system = 'A') AS a, coalesce(sum(area_ha) FILTER (WHERE production_system = 'I'), 0)
      + coalesce(sum(area_ha) FILTER (WHERE production_system = 'R'), 0) AS ir FROM x GROUP BY r, c, crop)
    SELECT {RC}, {r6('sum(coalesce(a, ir))', 'total_area')} FROM k GROUP BY r, c""")
def _(v):
    system = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "I").otherwise("R")
    part = v.table("part").select("p_partkey", F.col("p_brand").alias("crop"))
    x = v.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_partkey") % 36).alias("r"), (F.col("l_orderkey") % 72).alias("c"), "crop", system.alias("production_system"),
        F.col("l_quantity").alias("area_ha"),
    )
    return C.total_area(x)


@query("coverage_ratio", duck("v_crop_area", "v_cells") + f""", k AS (SELECT sum(area_ha) / any_value(pop) AS q FROM v_crop_area JOIN v_cells USING (r, c) GROUP BY r, c)
    SELECT {r6('min(q)', 'q000')}, {r6('quantile_cont(q, 0.01)', 'q010')}, {r6('quantile_cont(q, 0.5)', 'q500')}, {r6('quantile_cont(q, 0.99)', 'q990')},
    {r6('max(q)', 'q1000')} FROM k""")
def _(v):
    areas = v.crop_area.groupBy("r", "c").agg(F.sum("area_ha").alias("a")).join(v.cells.select("r", "c", "pop"), ["r", "c"])
    return C.coverage_ratio(areas, "a", "pop", {"q000": 0.0, "q010": 0.01, "q500": 0.5, "q990": 0.99, "q1000": 1.0})


HARMONIZED = ", x AS (SELECT r, c, substr(crop, 1, 7) AS grp, CASE WHEN area_ha > 30 THEN yield_kg_ha END AS value FROM v_crop_area)"


def _harmonize(v, how):
    x = v.crop_area.select("r", "c", F.substring("crop", 1, 7).alias("grp"), F.when(F.col("area_ha") > 30, F.col("yield_kg_ha")).alias("value"))
    return C.harmonize(x, how, group="grp")


@query("harmonize_mean", duck("v_crop_area") + HARMONIZED + f"SELECT {RC}, grp, {r6('avg(value)', 'value')} FROM x GROUP BY r, c, grp")
def _(v):
    return _harmonize(v, "mean")


@query("harmonize_max", duck("v_crop_area") + HARMONIZED + f"SELECT {RC}, grp, {r6('max(value)', 'value')} FROM x GROUP BY r, c, grp")
def _(v):
    return _harmonize(v, "max")


@query("weighted_mean", duck("v_oof") + f"""SELECT {big('cls')}, {r6('sum(w * y) FILTER (WHERE w > 20) / sum(w) FILTER (WHERE w > 20)', 'mean')} FROM v_oof GROUP BY cls""")
def _(v):
    w = F.when(F.col("w") > 20, F.col("w")).otherwise(-F.col("w"))
    return v.oof.groupBy("cls").agg(M.weighted_mean(F.col("y"), w).alias("mean"))


def weighted_quantile_sql(variant: str) -> str:
    """Bracketing rows of each quantile by brute force."""
    x = "cum / tot" if variant == "total" else "(cum - w / 2) / tot"
    cols = []
    for name, q in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99)):
        lo = f"max(struct_pack(x := x, v := v)) FILTER (WHERE x <= {q})"
        hi = f"min(struct_pack(x := x, v := v)) FILTER (WHERE x >= {q})"
        cols.append(r6(f"""CASE WHEN {lo} IS NULL THEN ({hi}).v WHEN {hi} IS NULL THEN ({lo}).v WHEN ({hi}).x = ({lo}).x THEN ({lo}).v
            ELSE ({lo}).v + (({hi}).v - ({lo}).v) * ({q} - ({lo}).x) / (({hi}).x - ({lo}).x) END""", f"{variant}_{name}"))
    return f"(SELECT cls, {', '.join(cols)} FROM (SELECT cls, v, {x} AS x FROM k) GROUP BY cls)"


@query("weighted_quantile", duck("v_oof") + f""", k AS (SELECT cls, v, w, sum(w) OVER (PARTITION BY cls ORDER BY v, w, id) AS cum, sum(w) OVER (PARTITION BY cls) AS tot
    FROM (SELECT cls, p_cand AS v, w, id FROM v_oof)) SELECT {big('cls')}, total_q10, total_q50, total_q99, midpoint_q10, midpoint_q50, midpoint_q99
    FROM {weighted_quantile_sql('total')} a JOIN {weighted_quantile_sql('midpoint')} b USING (cls)""")
def _(v):
    from gridspark.operators.scan import weighted_quantiles

    out = None
    for variant in ("total", "midpoint"):
        probs = {f"{variant}_q10": 0.1, f"{variant}_q50": 0.5, f"{variant}_q99": 0.99}
        q = weighted_quantiles(v.oof, "p_cand", "w", probs, ["cls"], variant)
        out = q if out is None else out.join(q, "cls")
    return out


@query("quantiles", duck("v_cells") + f""", u AS (SELECT 'frac' AS feature, frac AS x FROM v_cells UNION ALL SELECT 'pop', pop FROM v_cells)
    SELECT feature, {r6('quantile_cont(x, 0.01)', 'p01')}, {r6('quantile_cont(x, 0.25)', 'p25')}, {r6('quantile_cont(x, 0.75)', 'p75')},
    {r6('quantile_cont(x, 0.99)', 'p99')}, {r6('ceil(round(greatest(quantile_cont(x, 0.99), 0.01) * 100, 6)) / 100', 'display_limit')} FROM u GROUP BY feature""")
def _(v):
    q = Y.quantiles(v.cells, ["frac", "pop"], {"p01": 0.01, "p25": 0.25, "p75": 0.75, "p99": 0.99})
    return q.withColumn("display_limit", Y.rounded_limit(F.col("p99")))


@query("variable_summary", duck("v_cells") + f""", d AS (SELECT *, CASE WHEN c % 9 = 0 THEN NULL ELSE pot_irr END AS irr FROM v_cells),
    u AS (SELECT 'frac' AS feature, frac AS x FROM d UNION ALL SELECT 'irr', irr FROM d UNION ALL SELECT 'soil', soil FROM d)
    SELECT feature, count(x) AS n, {big('count(*) - count(x)', 'n_missing')}, count(DISTINCT x) AS n_unique, {r6('min(x)', 'min')}, {r6('max(x)', 'max')},
    {r6('avg(x)', 'mean')}, {r6('quantile_cont(x, 0.01)', 'p01')}, {r6('median(x)', 'median')}, {r6('quantile_cont(x, 0.99)', 'p99')} FROM u GROUP BY feature""")
def _(v):
    d = v.cells.withColumn("irr", F.when(F.col("c") % 9 != 0, F.col("pot_irr")))
    return Y.variable_summary(d, ["frac", "irr", "soil"])


@query("histogram", duck("v_oof") + f""", x AS (SELECT p_cand + w / 1000 AS x FROM v_oof), l AS (SELECT quantile_cont(x, 0.005) AS lo, quantile_cont(x, 0.995) AS hi FROM x),
    b AS (SELECT least(floor((x - lo) / ((hi - lo) / 55)), 54) AS bin FROM x, l WHERE x BETWEEN lo AND hi)
    SELECT {big('bin')}, count(*) AS n, {r6('count(*) * 100.0 / (SELECT count(*) FROM b)', 'share_pct')} FROM b GROUP BY bin""")
def _(v):
    return Y.histogram(v.oof.select((F.col("p_cand") + F.col("w") / 1000).alias("x")), "x")


@query("value_counts", duck("v_cells") + f"SELECT {big('soil')}, count(*) AS n, {r6('count(*) / (SELECT count(*) FROM v_cells)', 'share')} FROM v_cells GROUP BY soil")
def _(v):
    return Y.value_counts(v.cells, "soil")


def metric_sql(p: str = "p", w: str = "1.0") -> str:
    """The metric columns by their textbook definitions."""
    spread = f"(sum({w} * y * y) - sum({w} * y) * sum({w} * y) / sum({w}))"
    return f"""count(*) AS n_cells, {r6(f'sum({w} * y) / sum({w})', 'observed_mean')}, {r6(f'sum({w} * {p}) / sum({w})', 'predicted_mean')},
    {r6(f'sum({w} * ({p} - y)) / sum({w})', 'bias_predicted_minus_observed')}, {r6(f'sum({w} * (y - {p})) / sum({w})', 'bias_observed_minus_predicted')},
    {r6(f'sqrt(sum({w} * ({p} - y) * ({p} - y)) / sum({w}))', 'rmse')}, {r6(f'sum({w} * abs({p} - y)) / sum({w})', 'mae')},
    {r6(f'CASE WHEN {spread} > 1e-12 * sum({w} * y * y) THEN 1 - sum({w} * ({p} - y) * ({p} - y)) / ({spread}) END', 'r2')}"""


@query("regression_metrics", duck("v_oof") + f"SELECT {metric_sql('p_cand', 'w')}, {r6('quantile_cont(abs(p_cand - y), 0.95)', 'absolute_error_p95')} FROM v_oof")
def _(v):
    return M.regression_metrics(v.oof, "y", "p_cand", "w", p95=True)


LONG = ", l AS (SELECT id, block, cls, lat, lon, y, w, 'base' AS model, p_base AS p FROM v_oof UNION ALL SELECT id, block, cls, lat, lon, y, w, 'cand', p_cand FROM v_oof)"
MODELS = {"base": "p_base", "cand": "p_cand"}


@query("metrics_by_group", duck("v_oof") + LONG + f"SELECT model, {big('block')}, {metric_sql()} FROM l GROUP BY model, block")
def _(v):
    long = M.models_long(v.oof, MODELS, ["block", "y"])
    return M.regression_metrics(long, "y", "p", by=["model", "block"])


@query("metric_deltas", duck("v_oof", "v_regions") + LONG + f""", m AS (SELECT model, region, sqrt(avg((p - y) * (p - y))) AS rmse, avg(abs(p - y)) AS mae,
      1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM l JOIN v_regions
      ON lat BETWEEN s_lat AND n_lat AND lon BETWEEN w_lon AND e_lon GROUP BY model, region)
    SELECT a.model, a.region, {r6('b.rmse - a.rmse', 'rmse_improvement_vs_baseline')}, {r6('(b.rmse - a.rmse) / b.rmse * 100', 'rmse_improvement_pct')},
    {r6('b.mae - a.mae', 'mae_improvement_vs_baseline')}, {r6('a.r2 - b.r2', 'r2_gain_vs_baseline')}, b.rmse - a.rmse > 0 AS rmse_improved
    FROM m a JOIN m b ON b.region = a.region AND b.model = 'base'""")
def _(v):
    inside = region_join(v.oof, v.regions)
    metrics = M.regression_metrics(M.models_long(inside, MODELS, ["region", "y"]), "y", "p", by=["model", "region"])
    return M.metric_deltas(metrics, "base", ["region"]).select(
        "model", "region", "rmse_improvement_vs_baseline", "rmse_improvement_pct", "mae_improvement_vs_baseline", "r2_gain_vs_baseline", "rmse_improved"
    )


@query("auc", duck("v_oof") + f""", g AS (SELECT cls, p_cand AS s, sum(CASE WHEN presence = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN presence = 0 THEN w ELSE 0 END) AS n
      FROM v_oof GROUP BY cls, p_cand)
    SELECT {big('a.cls', 'cls')}, {r6('sum(CASE WHEN b.s < a.s THEN a.p * b.n WHEN b.s = a.s THEN a.p * b.n / 2 END) / (sum(a.p * b.n))', 'auc')}
    FROM g a JOIN g b ON a.cls = b.cls GROUP BY a.cls""")
def _(v):
    return M.roc_auc(v.oof, "presence", "p_cand", "w", ["cls"])


@query("average_precision", duck("v_oof") + f""", g AS (SELECT p_base AS s, sum(presence * w) AS p, sum(w) AS a FROM v_oof GROUP BY 1),
    k AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(a) OVER (ORDER BY s DESC) AS seen, sum(p) OVER () AS tot FROM g)
    SELECT {r6('sum(p / tot * tp / seen)', 'average_precision')} FROM k""")
def _(v):
    return M.average_precision(v.oof, "presence", "p_base", "w")


@query("accuracy_at", duck("v_oof") + f"SELECT {big('cls')}, {r6('avg(CASE WHEN (p_base >= 0.5) = (presence = 1) THEN 1.0 ELSE 0.0 END)', 'accuracy')} FROM v_oof GROUP BY cls")
def _(v):
    return M.accuracy_at(v.oof, "presence", "p_base", by=["cls"])


# Observed shares per cell and crop against the share by yield; the cell's weight is its crop count.
SHARES = """, s AS (SELECT r, c, crop, area_ha / sum(area_ha) OVER (PARTITION BY r, c) AS y, yield_kg_ha / sum(yield_kg_ha) OVER (PARTITION BY r, c) AS p,
    CAST(count(*) OVER (PARTITION BY r, c) AS DOUBLE) AS w FROM v_crop_area)"""


def shares(v):
    totals = {"_a": F.sum("area_ha"), "_y": F.sum("yield_kg_ha"), "w": rows().cast("double")}
    t = C.with_group_totals(v.crop_area, ["r", "c"], **totals)
    return t.select("r", "c", "crop", (F.col("area_ha") / F.col("_a")).alias("y"), (F.col("yield_kg_ha") / F.col("_y")).alias("p"), "w")


@query("share_metrics", duck("v_crop_area") + SHARES + f""", m AS (SELECT *, sum(w * y) OVER (PARTITION BY crop) / sum(w) OVER (PARTITION BY crop) AS ym FROM s),
    k AS (SELECT crop, sum(w * (y - p) * (y - p)) AS sse, sum(w * (y - ym) * (y - ym)) AS sst, sum(-w * y * ln(least(greatest(p, 1e-12), 1))) AS ce, sum(w) AS w
      FROM m GROUP BY crop),
    d AS (SELECT r, c, min(struct_pack(a := -y, crop := crop)).crop AS t, min(struct_pack(a := -p, crop := crop)).crop AS g, max(w) AS w FROM s GROUP BY r, c)
    SELECT {r6('(SELECT sum(ce) FROM k) / (SELECT sum(w) FROM d)', 'cross_entropy')}, {r6('(SELECT sqrt(sum(sse) / sum(w)) FROM k)', 'share_rmse')},
    {r6('(SELECT 1 - sum(sse) / sum(sst) FROM k)', 'r2')}, {r6('(SELECT avg(1 - sse / sst) FROM k)', 'crop_r2_mean')},
    {r6('(SELECT median(1 - sse / sst) FROM k)', 'crop_r2_median')}, {r6('(SELECT sum(CASE WHEN t = g THEN w ELSE 0 END) / sum(w) FROM d)', 'dominant_accuracy')}""")
def _(v):
    return M.share_metrics(shares(v))


@query("global_share_baseline", duck("v_crop_area") + SHARES + f""", k AS (SELECT crop, sum(w * y) / sum(w) AS m FROM s GROUP BY crop)
    SELECT crop, {r6('m / (SELECT sum(m) FROM k)', 'mean_share')} FROM k""")
def _(v):
    return M.global_share_baseline(shares(v))


@query("improved_share", duck("v_oof") + f"""SELECT {big('cls')}, {r6('sum(CASE WHEN abs(p_cand - y) < abs(p_base - y) THEN w ELSE 0 END) / sum(w) * 100', 'improved_pct')}
    FROM v_oof GROUP BY cls""")
def _(v):
    share = M.improved_share(F.col("p_base"), F.col("p_cand"), F.col("y"), F.col("w"))
    return v.oof.groupBy("cls").agg(share.alias("improved_pct"))


@query("fold_summary", duck("v_oof") + LONG + f""", f AS (SELECT model, block % 5 AS fold, sqrt(avg((p - y) * (p - y))) AS rmse FROM l GROUP BY 1, 2)
    SELECT model, {r6('avg(rmse)', 'mean')}, {r6('stddev_samp(rmse)', 'sd')}, {r6('min(rmse)', 'min')}, {r6('max(rmse)', 'max')}, count(*) AS n_folds FROM f GROUP BY model""")
def _(v):
    long = M.models_long(v.oof, MODELS, ["block", "y"]).withColumn("fold", F.col("block") % 5)
    return Y.fold_summary(M.regression_metrics(long, "y", "p", by=["model", "fold"]), ["model"], "rmse")


@query("grouping_overall_fold", duck("v_oof") + LONG + f""", f AS (SELECT *, block % 5 AS fold FROM l)
    SELECT 'overall' AS scope, model, CAST(NULL AS BIGINT) AS fold, count(*) AS n, {r6('avg(p - y)', 'bias')} FROM f GROUP BY model
    UNION ALL SELECT 'fold', model, {big('fold')}, count(*), {r6('avg(p - y)', 'bias')} FROM f GROUP BY model, fold""")
def _(v):
    long = M.models_long(v.oof, MODELS, ["block", "y"]).withColumn("fold", F.col("block") % 5)
    scopes = {"overall": ["model"], "fold": ["model", "fold"]}
    return Y.overall_and_by(long, scopes, [rows().alias("n"), F.avg(F.col("p") - F.col("y")).alias("bias")])
