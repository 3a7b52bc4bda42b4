"""Comparison pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.fixtures import duck
from gridspark.plans import catalog as C
from gridspark.plans import comparison as P
from gridspark.queries.aggregates import metric_sql
from gridspark.queries.registry import big, bigs, query, r6

RC = bigs("r", "c")
# One row per cell: mean observation and mean predictions of both models.
CELL = """, k AS (SELECT r, c, any_value(lat) AS lat, any_value(lon) AS lon, avg(y) AS y, avg(p_base) AS po, avg(p_cand) AS pn, sum(w) AS w FROM v_oof GROUP BY r, c)"""


def pairs(v):
    cells = v.oof.groupBy("r", "c").agg(
        F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.avg("y").alias("y"), F.avg("p_base").alias("po"), F.avg("p_cand").alias("pn"), F.sum("w").alias("w")
    )
    old = cells.select("r", "c", "lat", "lon", "y", "w", F.col("po").alias("p"))
    return P.paired(old, cells.select("r", "c", "y", F.col("pn").alias("p")), ["r", "c"])


@query("model_change_cells", duck("v_oof") + CELL + f"""SELECT {RC}, {r6('po - y', 'residual_old')}, {r6('pn - y', 'residual_new')},
    {r6('abs(po - y) - abs(pn - y)', 'abs_error_improvement')}, {r6('pn - po', 'prediction_change')} FROM k""")
def _(v):
    return P.model_change(pairs(v)).select("r", "c", "residual_old", "residual_new", "abs_error_improvement", "prediction_change")


def _fit(p: str, w: str, tag: str) -> str:
    return f"""sqrt(sum({w} * ({p} - y) * ({p} - y)) / sum({w})) AS rmse_{tag}, sum({w} * abs({p} - y)) / sum({w}) AS mae_{tag},
    1 - sum({w} * ({p} - y) * ({p} - y)) / (sum({w} * y * y) - sum({w} * y) * sum({w} * y) / sum({w})) AS r2_{tag}"""


REGIONAL = """, x AS (SELECT region, weighting, y, po, pn, CASE weighting WHEN 'weighted' THEN w ELSE 1.0 END AS w FROM k JOIN v_regions
      ON lat BETWEEN s_lat AND n_lat AND lon BETWEEN w_lon AND e_lon, (VALUES ('weighted'), ('unweighted')) t(weighting)),
    m AS (SELECT region, weighting, count(*) AS n_cells, """ + _fit("po", "w", "old") + ", " + _fit("pn", "w", "new") + """,
      sum(CASE WHEN abs(pn - y) < abs(po - y) THEN w ELSE 0 END) / sum(w) * 100 AS imp, sum(w * abs(pn - po)) / sum(w) AS chg FROM x GROUP BY ALL)"""


@query("regional_change_metrics", duck("v_oof", "v_regions") + CELL + REGIONAL + f"""SELECT region, weighting, n_cells, {r6('rmse_old')}, {r6('mae_old')}, {r6('r2_old')},
    {r6('rmse_new')}, {r6('mae_new')}, {r6('r2_new')}, {r6('imp', 'improved_pct')}, {r6('chg', 'mean_abs_change')}, {r6('(rmse_new / rmse_old - 1) * 100', 'rmse_change_pct')} FROM m""")
def _(v):
    return P.regional_change(pairs(v), v.regions, "w")


def _side(p: str, tag: str) -> str:
    return f"{_fit(p, 'w', tag)}, sum(w * ({p} - y)) / sum(w) AS bias_{tag}"


@query("before_after_gdp", duck("v_oof") + CELL + f""", m AS (SELECT count(*) AS n_cells, {_side('po', 'a')}, {_side('pn', 'b')} FROM k)
    SELECT n_cells, {', '.join(f"{r6(f'{c}_a', f'{n}_before')}, {r6(f'{c}_b', f'{n}_after')}, {r6(f'{c}_b - {c}_a', f'{n}_delta')}"
    for c, n in (('rmse', 'rmse'), ('mae', 'mae'), ('r2', 'r2'), ('bias', 'bias_predicted_minus_observed')))} FROM m""")
def _(v):
    return P.before_after(pairs(v), "w")


@query("oof_diagnostics", duck("v_oof") + f"""SELECT {big('block')}, {metric_sql('p_cand')}, {r6('(SELECT quantile_cont(abs(p_cand - y), 0.995) FROM v_oof)', 'ae_cap')},
    {r6('(SELECT quantile_cont((p_cand - y) * (p_cand - y), 0.99) FROM v_oof)', 'se_cap')} FROM v_oof GROUP BY block""")
def _(v):
    return P.oof_diagnostics(v.oof, "y", "p_cand", "block")


@query("catalog_audit", duck("v_cells") + f""", cat AS (SELECT * FROM (VALUES ('frac', 'target'), ('pop', 'predictor'), ('gdp', 'predictor')) t(feature, kind)),
    u AS (SELECT 'frac' AS feature, frac AS x FROM v_cells UNION ALL SELECT 'pop', pop FROM v_cells UNION ALL SELECT 'soil', soil FROM v_cells),
    s AS (SELECT feature, count(x) AS n, {big('count(*) - count(x)', 'n_missing')}, count(DISTINCT x) AS n_unique, {r6('min(x)', 'min')}, {r6('max(x)', 'max')}, {r6('avg(x)', 'mean')},
      {r6('quantile_cont(x, 0.01)', 'p01')}, {r6('median(x)', 'median')}, {r6('quantile_cont(x, 0.99)', 'p99')} FROM u GROUP BY feature)
    SELECT coalesce(cat.feature, s.feature) AS feature, CASE WHEN s.feature IS NULL THEN 'missing' WHEN cat.feature IS NULL THEN 'unexpected' ELSE 'present' END AS status,
    kind, n, n_missing, n_unique, min, max, mean, p01, median, p99 FROM cat FULL JOIN s ON cat.feature = s.feature""")
def _(v):
    wanted = v.spark.createDataFrame([("frac", "target"), ("pop", "predictor"), ("gdp", "predictor")], "feature string, kind string")
    return C.catalog_audit(wanted, v.cells, ["frac", "pop", "soil"])


CATALOG = [("frac", "target", 1), ("pop", "predictor", 3), ("pot_rain", "predictor", 2), ("gdp", "predictor", 5), ("soil", "categorical", 4)]
CATALOG_SQL = ", ".join(f"('{f}', '{k}', {p})" for f, k, p in CATALOG)


def _catalog(v):
    return v.spark.createDataFrame(CATALOG, "feature string, kind string, position int")


@query("catalog_order", duck("v_cells") + f""", c AS (SELECT feature, row_number() OVER (ORDER BY position) - 1 AS position FROM (VALUES {CATALOG_SQL}) t(feature, kind, position)),
    names AS (SELECT feature, row_number() OVER (ORDER BY first) - 1 AS position FROM (SELECT 'frac' AS feature, 1 AS first, count(frac) AS n FROM v_cells UNION ALL SELECT 'pop', 2, count(pop) FROM v_cells
      UNION ALL SELECT 'pot_rain', 3, count(pot_rain) FROM v_cells) WHERE n > 0)
    SELECT {big('coalesce(c.position, names.position)', 'position')}, c.feature AS expected, names.feature AS actual, coalesce(c.feature = names.feature, FALSE) AS in_order
    FROM c FULL JOIN names ON c.position = names.position""")
def _(v):
    # The sample's features are those with any value, in its own order.
    names = ["frac", "pop", "pot_rain"]
    counts = v.cells.agg(*[F.count(n).alias(n) for n in names]).first()
    return C.catalog_order(_catalog(v), [n for n in names if counts[n]])


@query("catalog_correlation", duck("v_cells") + f""", f AS (SELECT frac, pop, pot_rain FROM v_cells WHERE frac IS NOT NULL AND pop IS NOT NULL AND pot_rain IS NOT NULL),
    k AS (SELECT {', '.join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ('frac', 'pop', 'pot_rain'))} FROM f)
    SELECT * FROM ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr({a}, {b})', 'spearman')} FROM k" for a in ('frac', 'pop', 'pot_rain') for b in ('frac', 'pop', 'pot_rain'))})""")
def _(v):
    return C.catalog_correlation(_catalog(v), v.cells)
