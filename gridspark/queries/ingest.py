"""Sources, sinks and normalisation at ingest."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from gridspark.fixtures import CELLS, duck
from gridspark.functions import grid as G
from gridspark.functions import scalar as S
from gridspark.operators import layers
from gridspark.queries.registry import big, bigs, query, r6, r6s
from gridspark.sources import tables


def scratch(v, label: str) -> str:
    """A fresh folder below the shared checkpoint folder; only local masters may go without one."""
    shared = v.spark.conf.get("spark.checkpoint.dir", None)
    if shared is not None:
        return f"{shared}/gridspark-{label}-{uuid.uuid4().hex}"
    if not v.spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix=f"gridspark-{label}-")


@query("scan_layer", "SELECT l_partkey, l_suppkey, round(l_discount, 6) AS l_discount FROM lineitem")
def _(v):
    return tables.scan_layer(v.spark, f"{v.sf_dir}/lineitem.parquet", ["l_partkey", "l_suppkey", "l_discount"])


@query("sink_table", duck("v_cube") + f"SELECT {bigs('yr', 'r', 'c')}, {r6('v')} FROM v_cube")
def _(v):
    path = tables.write_table(v.cube, scratch(v, "sink") + "/cube", partition_by=["yr"])
    return tables.scan_layer(v.spark, path, ["yr", "r", "c", "v"])


@query("load_or_build", duck("v_cells") + f"SELECT {bigs('r', 'c')}, {r6('frac')} FROM v_cells")
def _(v):
    path = scratch(v, "cache") + "/cells"
    build = lambda: v.cells.select("r", "c", "frac")
    sources = [f"{v.sf_dir}/lineitem.parquet"]
    tables.load_or_build(v.spark, path, CELLS, build, sources=sources)
    return tables.load_or_build(v.spark, path, CELLS, build, sources=sources)


@query("null_sentinels", duck("v_fine") + f"""SELECT {bigs('fr', 'fc')},
    {r6("CASE WHEN v IN (65535, -9999) OR isnan(v) THEN NULL ELSE v END", "v")} FROM v_fine""")
def _(v):
    return v.fine.select("fr", "fc", S.null_sentinels(F.col("v")).alias("v"))


@query("numeric_coerce", duck("v_codes") + "SELECT id, TRY_CAST(raw_text AS DOUBLE) AS number FROM v_codes")
def _(v):
    return v.codes.select("id", S.numeric_coerce(F.col("raw_text")).alias("number"))


@query("normalize_lon", duck("v_codes") + f"SELECT id, {r6('(lon360 + 180) % 360 - 180', 'lon')} FROM v_codes")
def _(v):
    return v.codes.select("id", G.normalize_lon(F.col("lon360")).alias("lon"))


@query("orient_grid", duck("v_cells") + f"SELECT {big('35 - r', 'r')}, {big('c')}, {r6('frac')} FROM v_cells")
def _(v):
    return v.cells.select(G.flip_rows(F.col("r"), CELLS).alias("r"), "c", "frac")


@query("latlon_to_cell", duck("v_cells") + f"""SELECT {bigs('r', 'c')},
    {big("least(greatest(round_even((88.5 - (lat + 0.7)) / 3.0, 0), 0), 59)", "tr")},
    {big("least(greatest(round_even((lon - 0.7 + 178.5) / 3.0, 0), 0), 119)", "tc")} FROM v_cells""")
def _(v):
    spec = G.GridSpec(60, 120)
    return v.cells.select("r", "c", spec.row_of(F.col("lat") + 0.7).alias("tr"), spec.col_of(F.col("lon") - 0.7).alias("tc"))


@query("cell_center", duck("v_cells") + f"""SELECT {bigs('r', 'c')}, {r6('90 - (r + 0.5) * 5', 'lat')},
    {r6('-180 + (c + 0.5) * 5', 'lon')} FROM v_cells""")
def _(v):
    return v.cells.select("r", "c", CELLS.lat(F.col("r")).alias("lat"), CELLS.lon(F.col("c")).alias("lon"))


@query("time_to_year", duck("v_codes") + f"""SELECT id, {big('floor((1850 * 365.0 + days) / 365.0)', 'noleap')},
    {big("floor((1850 * 365.2425 + days) / 365.2425)", 'mean_calendar')},
    {big("year(DATE '1850-01-01' + CAST(days AS INT))", 'standard')} FROM v_codes""")
def _(v):
    days = F.col("days")
    return v.codes.select(
        "id",
        S.noleap_year(days, 1850).alias("noleap"),
        S.mean_calendar_year(days, 1850).alias("mean_calendar"),
        S.standard_year(days, "1850-01-01").alias("standard"),
    )


@query("select_year", duck("v_cube") + f"SELECT {bigs('r', 'c')}, {r6('v')} FROM v_cube WHERE yr = 1996")
def _(v):
    return layers.select_year(v.cube, 1996)


@query("unit_convert", duck("v_codes") + f"""SELECT id, unit, {r6('''lon360 * CASE unit WHEN 'kg m-2 s-1' THEN 31557600.0
    WHEN 'mm/d' THEN 365.25 WHEN 'mm/month' THEN 12.0 ELSE 1.0 END''', 'mm_yr')},
    {r6("CASE WHEN unit LIKE 'mm%' THEN lon360 / 1000.0 ELSE lon360 END", 'meters')} FROM v_codes""")
def _(v):
    return v.codes.select(
        "id", "unit",
        S.to_mm_per_year(F.col("lon360"), F.col("unit")).alias("mm_yr"),
        S.to_meters(F.col("lon360"), F.col("unit")).alias("meters"),
    )


@query("layer_stats", duck("v_fine") + f""", x AS (SELECT cls, CASE WHEN v <> 65535 THEN v END AS v FROM v_fine)
    SELECT {big('cls')}, count(v) AS n_valid, {big('count(*) - count(v)', 'n_missing')}, {r6('min(v)', 'min')},
    {r6('max(v)', 'max')}, {r6('avg(v)', 'mean')}, {r6('quantile_cont(v, 0.5)', 'median')},
    {r6('quantile_cont(v, 0.9)', 'p90')} FROM x GROUP BY cls""")
def _(v):
    clean = v.fine.select("cls", S.null_sentinels(F.col("v")).alias("v"))
    return layers.layer_stats(clean, "v", ["cls"])


@query("axis_profile", duck("v_cells") + f"SELECT {big('c')}, {r6('avg(frac)', 'mean')}, count(frac) AS n_valid FROM v_cells GROUP BY c")
def _(v):
    return layers.axis_profile(v.cells, "c", "frac")


@query("missing_years", duck("v_cube") + f"""SELECT {big('y', 'yr')} FROM range(1985, 2005) t(y)
    WHERE y NOT IN (SELECT yr FROM v_cube)""")
def _(v):
    return layers.missing_years(v.cube, 1985, 2004)


@query("manifest_upsert", """SELECT o_orderpriority AS layer, CAST(max(year(o_orderdate)) AS BIGINT) AS version,
    count(*) FILTER (WHERE year(o_orderdate) = my) AS n_rows
    FROM (SELECT *, max(year(o_orderdate)) OVER (PARTITION BY o_orderpriority) AS my FROM orders) GROUP BY 1""")
def _(v):
    path = scratch(v, "manifest") + "/rows"
    rows = v.table("orders").groupBy(
        F.col("o_orderpriority").alias("layer"), F.year("o_orderdate").alias("version")
    ).agg(F.count(F.lit(1)).alias("n_rows"))
    tables.append_manifest(rows.where(F.col("version") < 1995), path)
    tables.append_manifest(rows.where(F.col("version") >= 1995), path)
    return tables.latest_manifest(v.spark, path, ["layer"], "version")
