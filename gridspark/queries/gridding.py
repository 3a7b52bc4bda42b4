"""Re-gridding and temporal aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.fixtures import CELLS, FINE, duck
from gridspark.functions import scalar as S
from gridspark.functions.grid import GridSpec
from gridspark.operators import regrid as R
from gridspark.operators import temporal as T
from gridspark.operators import zones as Z
from gridspark.queries.registry import big, bigs, query, r6

# A target whose ratio to the fine grid is not an integer (7.2).
ODD = GridSpec(50, 100)
RC = bigs("r", "c")
CLEAN = ", x AS (SELECT fr, fc, v FROM v_fine WHERE v <> 65535)"
PAIRS = CLEAN + """, p AS (SELECT t.r, u.c, v,
    (least((fr + 1) * 50, (t.r + 1) * 360) - greatest(fr * 50, t.r * 360)) / 50.0
    * ((least((fc + 1) * 100, (u.c + 1) * 720) - greatest(fc * 100, u.c * 720)) / 100.0) AS w
    FROM x, range(50) t(r), range(100) u(c)
    WHERE fr * 50 < (t.r + 1) * 360 AND (fr + 1) * 50 > t.r * 360 AND fc * 100 < (u.c + 1) * 720 AND (fc + 1) * 100 > u.c * 720)"""


def clean_fine(v):
    return v.fine.select("fr", "fc", S.null_sentinels(F.col("v")).alias("v"), "cls")


@query("block_aggregate", duck("v_fine") + CLEAN + f"""SELECT {big('fr // 10 + 1', 'r')}, {big('fc // 10', 'c')}, {r6('avg(v)', 'mean')},
    {r6('min(v)', 'min')}, {r6('median(v)', 'median')}, count(v) AS n FROM x GROUP BY fr // 10, fc // 10""")
def _(v):
    return R.block_aggregate(clean_fine(v), 10, "v", row_offset=1)


@query("regrid_max", duck("v_fine") + PAIRS + f"SELECT {RC}, {r6('max(v)', 'v')} FROM p GROUP BY r, c")
def _(v):
    return R.regrid(clean_fine(v), FINE, ODD, "max", "v")


@query("regrid_sum", duck("v_fine") + PAIRS + f"SELECT {RC}, {r6('sum(v * w)', 'v')} FROM p GROUP BY r, c")
def _(v):
    return R.regrid(clean_fine(v), FINE, ODD, "sum", "v")


@query("regrid_average", duck("v_fine") + PAIRS + f"SELECT {RC}, {r6('sum(v * w) / sum(w)', 'v')} FROM p GROUP BY r, c")
def _(v):
    return R.regrid(clean_fine(v), FINE, ODD, "average", "v")


@query("regrid_mode", duck("v_fine") + f""", n AS (SELECT fr // 10 AS r, fc // 10 AS c, cls, count(*) AS n FROM v_fine GROUP BY 1, 2, 3)
    SELECT {RC}, {big('cls')} FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY n DESC, cls) AS k FROM n) WHERE k = 1""")
def _(v):
    return R.regrid(v.fine, FINE, CELLS, "mode", "cls")


@query("regrid_bilinear", duck("v_cells") + f""", t AS (SELECT r, c, (r + 0.5) * 36 / 108 - 0.5 AS y, (c + 0.5) * 72 / 216 - 0.5 AS x
    FROM range(108) a(r), range(216) b(c)),
    k AS (SELECT t.r, t.c, s.frac, (1 - abs(t.y - s.r)) * (1 - abs(t.x - s.c)) AS w FROM t, v_cells s
    WHERE abs(t.y - s.r) < 1 AND abs(t.x - s.c) < 1)
    SELECT {RC}, {r6('sum(frac * w) / sum(w)', 'frac')} FROM k WHERE w > 0 GROUP BY r, c""")
def _(v):
    return R.regrid(v.cells, CELLS, GridSpec(108, 216), "bilinear", "frac", "r", "c")


@query("regrid_nearest", duck("v_fine") + CLEAN + f"""SELECT {bigs('t.r', 'u.c').replace('AS t.r', 'AS r').replace('AS u.c', 'AS c')}, {r6('v')}
    FROM range(50) t(r), range(100) u(c), x WHERE fr = ((2 * t.r + 1) * 360) // 100 AND fc = ((2 * u.c + 1) * 720) // 200""")
def _(v):
    return R.regrid(clean_fine(v), FINE, ODD, "nearest", "v")


@query("fraction_corrected_avg", duck("v_fine") + f""", x AS (SELECT fr // 10 AS r, fc // 10 AS c, CASE WHEN v = 65535 THEN 0.0 ELSE v END AS v,
    CASE WHEN v = 65535 THEN 0.0 ELSE 1.0 END AS m FROM v_fine),
    a AS (SELECT r, c, avg(v) * 2.0 AS d, avg(m) AS coverage FROM x GROUP BY r, c)
    SELECT {RC}, {r6('coverage')}, {r6('CASE WHEN coverage >= 0.25 AND d / coverage >= 0 THEN least(d / coverage, 60.0) END', 'v')} FROM a""")
def _(v):
    x = clean_fine(v).select(
        F.expr("fr div 10").alias("r"), F.expr("fc div 10").alias("c"), F.coalesce("v", F.lit(0.0)).alias("v"),
        F.col("v").isNotNull().cast("double").alias("m"),
    )
    return R.fraction_corrected_avg(x, "v", "m", scale=2.0, cap=60.0)


@query("mosaic_best_coverage", duck("v_fine") + CLEAN + f""", a AS (SELECT fr // 10 AS r, fc // 10 AS c, fr % 3 AS source, avg(v) AS v,
    count(*) AS coverage FROM x GROUP BY 1, 2, 3)
    SELECT {RC}, {big('source')}, coverage, {r6('v')} FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY coverage DESC, source) AS k FROM a)
    WHERE k = 1""")
def _(v):
    sources = clean_fine(v).where("v IS NOT NULL").groupBy(
        F.expr("fr div 10").alias("r"), F.expr("fc div 10").alias("c"), F.expr("fr % 3").alias("source")
    ).agg(F.avg("v").alias("v"), F.count("v").alias("coverage"))
    return R.mosaic_best_coverage(sources, "v")


BOX = (-120.0, 60.0, -40.0, 50.0)


@query("one_degree_grid", duck("v_cells") + f""", x AS (SELECT floor((lat + 40) / 15) AS iy, floor((lon + 120) / 15) AS ix, frac, soil FROM v_cells
    WHERE lat BETWEEN -40 AND 50 AND lon BETWEEN -120 AND 60),
    n AS (SELECT iy, ix, soil, count(*) AS n FROM x GROUP BY ALL),
    m AS (SELECT iy, ix, soil FROM (SELECT *, row_number() OVER (PARTITION BY iy, ix ORDER BY n DESC, soil) AS k FROM n) WHERE k = 1)
    SELECT {bigs('iy', 'ix')}, {r6('median(frac)', 'frac')}, {big('any_value(m.soil)', 'soil')} FROM x JOIN m USING (iy, ix) GROUP BY iy, ix""")
def _(v):
    cells = v.cells
    middle = R.coarsen(cells, "frac", BOX, 15.0)
    return middle.join(R.coarsen(cells, "soil", BOX, 15.0, categorical=True), ["iy", "ix"])


@query("region_grid", duck("v_cells") + f"""SELECT {bigs('g.r', 'h.c').replace('AS g.r', 'AS r').replace('AS h.c', 'AS c')}, {r6('frac')}
    FROM range(5, 21) g(r) CROSS JOIN range(10, 41) h(c) LEFT JOIN v_cells s ON s.r = g.r AND s.c = h.c""")
def _(v):
    return R.region_grid(v.cells, "frac", CELLS, (5, 20), (10, 40))


# Two polygons (a diamond and a triangle) whose size follows the data: one ring vertex per nation, region by region.
VERTICES = """SELECT n_regionkey AS zone, 0 AS ring, n_nationkey AS seq,
    -150.0 + n_regionkey * 70.0 + 30.3 * cos(2 * pi() * (n_nationkey // 5) / 5.0) AS lon,
    10.1 + 40.7 * sin(2 * pi() * (n_nationkey // 5) / 5.0) AS lat FROM nation"""


@query("rasterize_zones", duck("v_cells") + f""", p AS ({VERTICES}),
    e AS (SELECT zone, lon AS x1, lat AS y1,
      coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2
      FROM p WINDOW w AS (PARTITION BY zone, ring ORDER BY seq)),
    hit AS (SELECT r, c, zone FROM v_cells, e WHERE least(y1, y2) <= lat AND lat < greatest(y1, y2)
      AND x1 + (lat - y1) * (x2 - x1) / (y2 - y1) <= lon GROUP BY r, c, zone HAVING count(*) % 2 = 1)
    SELECT {bigs('v.r', 'v.c').replace('AS v.r', 'AS r').replace('AS v.c', 'AS c')}, {big('min(zone)', 'zone')}, {r6('any_value(frac)', 'frac')}
    FROM v_cells v LEFT JOIN hit USING (r, c) GROUP BY v.r, v.c""")
def _(v):
    turn = "2 * pi() * (n_nationkey div 5) / 5.0"
    vertices = v.table("nation").selectExpr(
        "n_regionkey AS zone", "0 AS ring", "n_nationkey AS seq",
        f"CAST(-150.0 + n_regionkey * 70.0 AS DOUBLE) + 30.3D * cos({turn}) AS lon", f"10.1D + 40.7D * sin({turn}) AS lat",
    )
    burnt = Z.rasterize_zones(Z.edges(vertices), CELLS)
    return Z.zone_of(v.cells.select("r", "c", "frac"), burnt)


ANNUAL = f""", a AS (SELECT r, c, yr, quantile_cont(q, 0.1) AS p FROM v_daily WHERE q >= 0 GROUP BY r, c, yr)"""


@query("annual_p10", duck("v_daily") + ANNUAL + f"SELECT {bigs('r', 'c', 'yr')}, {r6('p')} FROM a")
def _(v):
    return T.annual_percentile(v.daily)


@query("period_mean", duck("v_daily") + ANNUAL + f"SELECT {RC}, {r6('avg(p)', 'p')}, count(p) AS n_years FROM a GROUP BY r, c")
def _(v):
    return T.period_mean(T.annual_percentile(v.daily))


@query("year_range_mean", duck("v_cube") + f"SELECT {RC}, {r6('avg(v)', 'v')} FROM v_cube WHERE yr BETWEEN 1994 AND 1996 GROUP BY r, c")
def _(v):
    return T.year_range_mean(v.cube, 1994, 1996)


@query("recent_window", duck("v_prices") + f"""SELECT {big('yr')}, count(*) AS n, {r6('avg(val)', 'mean')} FROM v_prices
    WHERE yr > (SELECT max(yr) FROM v_prices) - 5 GROUP BY yr""")
def _(v):
    return T.recent_window(v.prices).groupBy("yr").agg(F.count(F.lit(1)).alias("n"), F.avg("val").alias("mean"))


@query("period_label", duck("v_cube") + f"""SELECT {big('r')}, CASE WHEN min(yr) = max(yr) THEN CAST(min(yr) AS VARCHAR)
    ELSE min(yr) || '_' || max(yr) END AS period FROM v_cube WHERE yr >= 1992 + r % 7 GROUP BY r""")
def _(v):
    return v.cube.where("yr >= 1992 + r % 7").groupBy("r").agg(T.period_label().alias("period"))
