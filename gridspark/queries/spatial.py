"""Neighbourhoods, distances and spatial autocorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.fixtures import CELLS, duck
from gridspark.operators import neighbor as N
from gridspark.plans import river
from gridspark.queries.registry import big, bigs, query, r6

RC = bigs("r", "c")
RADIUS = 1000.0
# Half height of the box: ceil(1000 km / (km per degree * 5 degrees)) = 2.
GEOMETRY = """, k AS (SELECT 6371.0088 * pi() / 180 AS km),
    h AS (SELECT r, least(ceil(1000 / (km * greatest(cos(radians(90 - (r + 0.5) * 5)), 1e-6) * 5)), 35) AS half FROM range(36) t(r), k),
    g AS (SELECT r, c FROM range(36) t(r), range(72) u(c))"""


def boxes(source: str, edge: str) -> str:
    """Every target with every source cell of its box, by brute force; ``source`` has r, c, x."""
    row = "least(greatest(g.r + d, 0), 35)" if edge == "repeat" else "g.r + d"
    return GEOMETRY + f""", w AS (SELECT g.r, g.c, {row} AS rr FROM g, range(-2, 3) o(d)),
    n AS (SELECT w.r, w.c, sum(2 * half + 1) AS width FROM w JOIN h ON h.r = rr GROUP BY ALL),
    b AS (SELECT w.r, w.c, CAST(sum(CAST(s.x AS DECIMAL(38, 15))) AS DOUBLE) AS s, count(s.x) AS n FROM w JOIN h ON h.r = rr
      JOIN {source} s ON s.r = rr AND least((s.c - w.c + 72) % 72, (w.c - s.c + 72) % 72) <= half GROUP BY w.r, w.c)"""


SPARSE = ", src AS (SELECT r, c, frac AS x FROM v_cells WHERE (r < 12 OR c % 3 = 0))"


@query("box_mean_km", duck("v_cells") + SPARSE + boxes("src", "repeat") + f"""SELECT {bigs('g.r', 'g.c').replace('AS g.', 'AS ')},
    {r6('CASE WHEN n > 0 AND n >= 0.25 * width THEN s / n END', 'mean')}, {big('coalesce(n, 0)', 'n')}, {big('width')}
    FROM g JOIN n USING (r, c) LEFT JOIN b USING (r, c)""")
def _(v):
    source = v.cells.where("r < 12 OR c % 3 = 0").select("r", "c", F.col("frac").alias("value"))
    return N.box_mean_km(source, CELLS, RADIUS)


@query("box_sum_km", duck("v_cells") + ", src AS (SELECT r, c, pot_rain AS x FROM v_cells)" + boxes("src", "zero")
       + f"SELECT {bigs('g.r', 'g.c').replace('AS g.', 'AS ')}, {r6('coalesce(s, 0)', 'total')} FROM g LEFT JOIN b USING (r, c)")
def _(v):
    return N.box_sum_km(v.cells.select("r", "c", F.col("pot_rain").alias("value")), CELLS, RADIUS)


@query("neighbourhood_share", duck("v_cells") + ", src AS (SELECT r, c, frac AS x, CAST(n_src AS DOUBLE) / 20 AS y FROM v_cells)"
       + boxes("(SELECT r, c, x FROM src)", "zero")
       + f""", b2 AS (SELECT w.r, w.c, sum(CAST(s.y AS DECIMAL(38, 15))) AS s2 FROM w JOIN h ON h.r = rr
      JOIN src s ON s.r = rr AND least((s.c - w.c + 72) % 72, (w.c - s.c + 72) % 72) <= half GROUP BY w.r, w.c),
    q AS (SELECT r, c, CASE WHEN s2 >= 5 THEN s / CAST(s2 AS DOUBLE) END AS ratio FROM g LEFT JOIN b USING (r, c) LEFT JOIN b2 USING (r, c))
    SELECT {RC}, {r6('ratio', 'share_raw')}, {r6('CASE WHEN ratio IS NOT NULL THEN least(greatest(ratio, 0), 1) END', 'share')},
    coalesce(ratio, 0) > 1 AS above_one FROM q""")
def _(v):
    cells = v.cells
    num = cells.select("r", "c", F.col("frac").alias("value"))
    den = cells.select("r", "c", (F.col("n_src") / 20).alias("value"))
    return N.neighbourhood_share(num, den, CELLS, RADIUS)


def _distance_sql(mask: str, by: str = "", spec=(36, 72, 5.0)) -> str:
    rows, cols, step = spec
    lab = f"{by}, " if by else ""
    return f""", gg AS (SELECT r, c, 90 - (r + 0.5) * {step} AS lat, -180 + (c + 0.5) * {step} AS lon FROM range({rows}) t(r), range({cols}) u(c)),
    dd AS (SELECT {lab}a.r, a.c, (a.r - m.r) * (a.r - m.r) + (a.c - m.c) * (a.c - m.c) AS d2,
      2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
        + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km
      FROM gg a, {mask} m JOIN gg b ON b.r = m.r AND b.c = m.c),
    best AS (SELECT {lab}r, c, min(struct_pack(d2 := d2, km := km)) AS m FROM dd GROUP BY ALL)"""


@query("distance_to_mask", duck("v_cells") + ", mask AS (SELECT r, c FROM v_cells WHERE frac > 0.62 OR (r + c) % 97 = 0)" + _distance_sql("mask")
       + f"SELECT {RC}, {big('m.d2', 'index_distance2')}, {r6('m.km', 'km')} FROM best")
def _(v):
    mask = v.cells.where("frac > 0.62 OR (r + c) % 97 = 0").select("r", "c")
    return N.distance_to_mask(mask, CELLS)


KNN = """, pts AS (SELECT r * 72 + c AS id, lat, lon, val, grp FROM src),
    pairs AS (SELECT a.id, b.id AS neighbour, {by} round(2 * 6371.0088 * asin(sqrt(least(1.0,
      pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 6) AS km
      FROM pts a JOIN pts b ON a.id <> b.id {cond}),
    knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, neighbour) AS rank FROM pairs) WHERE rank <= 8)"""
CELL_POINTS = ", src AS (SELECT r, c, lat, lon, frac AS val, r % 2 AS grp FROM v_cells)"


@query("knn_haversine", duck("v_cells") + CELL_POINTS + KNN.format(by="", cond="") + f"SELECT {bigs('id', 'neighbour', 'rank')}, {r6('km')} FROM knn")
def _(v):
    points = v.cells.select((F.col("r") * 72 + F.col("c")).alias("id"), "lat", "lon")
    return N.knn_haversine(points)


MORAN_SRC = ", src AS (SELECT r, c, any_value(lat) AS lat, any_value(lon) AS lon, avg(y - p_base) AS val, r % 5 AS grp FROM v_oof GROUP BY r, c)"


def _residuals(v):
    return v.oof.groupBy("r", "c").agg(
        F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.avg(F.col("y") - F.col("p_base")).alias("val")
    ).select((F.col("r") * 72 + F.col("c")).alias("id"), (F.col("r") % 5).alias("grp"), "lat", "lon", "val")


def _moran_tail(by: str) -> str:
    g = f"{big('grp')}, " if by else ""
    join = "USING (grp)" if by else "ON TRUE"
    group = "GROUP BY grp" if by else ""
    pick = "grp, " if by else ""
    return f""", st AS (SELECT {pick}count(*) AS n, avg(val) AS m, stddev_pop(val) AS sd FROM pts {group}),
    cr AS (SELECT {'p.grp, ' if by else ''}sum((p.val - st.m) * (q.val - st.m)) AS x, median(km) AS med FROM knn JOIN pts p ON p.id = knn.id
      JOIN pts q ON q.id = knn.neighbour JOIN st ON {'st.grp = p.grp' if by else 'TRUE'} {'GROUP BY p.grp' if by else ''})
    SELECT {g}n, {r6('m', 'residual_mean')}, {r6('sd', 'residual_sd')}, {r6('med', 'median_neighbour_km')},
    {r6('CASE WHEN sd > 0 THEN x / (8 * n * sd * sd) END', 'morans_i')}, {r6('-1.0 / (n - 1)', 'expected')} FROM st JOIN cr {join}"""


@query("morans_i", duck("v_oof") + MORAN_SRC + KNN.format(by="", cond="") + _moran_tail(""))
def _(v):
    return N.morans_i(_residuals(v), "val")


@query("morans_i_by_fold", duck("v_oof") + MORAN_SRC + KNN.format(by="", cond="AND a.grp = b.grp") + _moran_tail("grp"))
def _(v):
    return N.morans_i(_residuals(v), "val", by=["grp"])


RIVER = """, a AS (SELECT r, c, yr, quantile_cont(q, 0.1) AS p FROM v_daily WHERE q >= 0 GROUP BY r, c, yr),
    pm AS (SELECT r, c, avg(p) AS p FROM a GROUP BY r, c),
    coarse AS (SELECT t.r, u.c, max(p) AS p FROM pm s, range(27) t(r), range(54) u(c)
      WHERE s.r * 27 < (t.r + 1) * 36 AND (s.r + 1) * 27 > t.r * 36 AND s.c * 54 < (u.c + 1) * 72 AND (s.c + 1) * 54 > u.c * 72 GROUP BY ALL),
    mask AS (SELECT label, r, c FROM coarse, (VALUES ('0p5', 0.5), ('1', 1.0), ('2', 2.0)) AS th(label, t) WHERE p > t)"""


@query("river_reliability", duck("v_daily") + RIVER + _distance_sql("mask", "label", (27, 54, "(180.0 / 27)"))
       + f"SELECT label, {RC}, {r6('p', 'p10')}, {r6('m.km', 'km')} FROM best LEFT JOIN coarse USING (r, c)")
def _(v):
    from gridspark.functions.grid import GridSpec

    return river.river_reliability(v.daily, CELLS, GridSpec(27, 54), [0.5, 1.0, 2.0])
