"""Projections, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.fixtures import CELLS, duck
from gridspark.functions import grid as G
from gridspark.functions import scalar as S
from gridspark.functions import text as X
from gridspark.operators import joins, layers
from gridspark.queries.registry import big, bigs, query, r6, r6s

# A cell column with a sentinel, negatives and NULLs in it.
DIRTY = "CASE WHEN c % 9 = 0 THEN NULL WHEN c % 5 = 0 THEN -pot_rain ELSE pot_rain END"
KEYS = bigs("r", "c")


def dirty(v):
    return v.cells.withColumn("x", F.expr(DIRTY))


def over_dirty(*columns: str) -> str:
    return duck("v_cells") + f", d AS (SELECT *, {DIRTY} AS x FROM v_cells) SELECT {KEYS}, {', '.join(columns)} FROM d"


@query("safe_log1p", over_dirty(r6("CASE WHEN x > 0 THEN ln(1 + x) ELSE 0 END", "zero"),
                                r6("CASE WHEN x > 0 THEN ln(1 + x) WHEN x <= 0 THEN 0 END", "kept")))
def _(v):
    x = F.col("x")
    return dirty(v).select("r", "c", S.safe_log1p(x).alias("zero"), S.safe_log1p(x, keep_null=True).alias("kept"))


@query("nonneg_or_null", over_dirty(r6("CASE WHEN x >= 0 THEN x END", "raw"), r6("CASE WHEN x >= 0 THEN ln(1 + x) END", "logged")))
def _(v):
    return dirty(v).select("r", "c", S.nonneg_or_null(F.col("x")).alias("raw"), S.log_nonneg(F.col("x")).alias("logged"))


@query("log10p", over_dirty(r6("CASE WHEN x IS NOT NULL THEN log10(1 + greatest(x, 0)) END", "y")))
def _(v):
    return dirty(v).select("r", "c", S.log10p(F.col("x")).alias("y"))


@query("positive_raw", over_dirty(r6("CASE WHEN x > 0 THEN x ELSE 0 END", "y")))
def _(v):
    return dirty(v).select("r", "c", S.positive_raw(F.col("x")).alias("y"))


@query("positive_with_flags", over_dirty(
    r6("CASE WHEN x > 0 THEN x ELSE 0 END", "y"), big("CASE WHEN x > 0 THEN 1 ELSE 0 END", "exists_flag"),
    big("CASE WHEN x IS NULL THEN 1 ELSE 0 END", "missing_flag")))
def _(v):
    y, exists, missing = S.positive_flags(F.col("x"))
    return dirty(v).select("r", "c", y.alias("y"), exists.alias("exists_flag"), missing.alias("missing_flag"))


@query("paired_gain", over_dirty(
    r6("CASE WHEN x IS NOT NULL THEN greatest(pot_irr - x, 0) ELSE 0 END", "gain"),
    r6("CASE WHEN x IS NOT NULL THEN pot_irr - x ELSE 0 END", "signed_gain")))
def _(v):
    irr, rain = F.col("pot_irr"), F.col("x")
    return dirty(v).select("r", "c", S.paired_gain(irr, rain).alias("gain"), S.paired_gain(irr, rain, signed=True).alias("signed_gain"))


@query("clip_unit", over_dirty(
    r6("least(greatest(frac, 0.3), 0.6)", "clipped"),
    r6("CASE WHEN x IS NOT NULL THEN least(greatest(x / 100, 0), 1) END", "share")))
def _(v):
    d = dirty(v)
    return d.select("r", "c", S.clip(F.col("frac"), 0.3, 0.6).alias("clipped"), layers.rescaled_fraction(d, "x").alias("share"))


@query("safe_divide", over_dirty(r6("CASE WHEN x > 0 THEN pop / x END", "ratio"), r6("CASE WHEN x > 0 THEN pop / x ELSE 0 END", "ratio0")))
def _(v):
    return dirty(v).select("r", "c", S.safe_divide(F.col("pop"), F.col("x")).alias("ratio"),
                           S.safe_divide(F.col("pop"), F.col("x"), 0.0).alias("ratio0"))


@query("cell_area", duck("v_cells") + f"""SELECT {KEYS}, {r6('''6371.0088 * 6371.0088 * radians(5.0)
    * (sin(radians(90 - r * 5.0)) - sin(radians(90 - (r + 1) * 5.0)))''', 'km2')},
    {r6('''6371000.0 * 6371000.0 * radians(5.0) * (sin(radians(90 - r * 5.0)) - sin(radians(90 - (r + 1) * 5.0))) / 1e4
    / 1e6''', 'mha')} FROM v_cells""")
def _(v):
    r = F.col("r")
    return v.cells.select("r", "c", CELLS.area(r).alias("km2"), (CELLS.area(r, G.EARTH_RADIUS_M) / 1e4 / 1e6).alias("mha"))


@query("haversine", duck("v_cells") + f"""SELECT {KEYS}, {r6('''2 * 6371.0088 * asin(sqrt(least(1.0,
    pow(sin((radians(35.5) - radians(lat)) / 2), 2)
    + cos(radians(lat)) * cos(radians(35.5)) * pow(sin(radians(139.5 - lon) / 2), 2))))''', 'km')} FROM v_cells""")
def _(v):
    return v.cells.select("r", "c", G.haversine_km(F.col("lat"), F.col("lon"), F.lit(35.5), F.lit(139.5)).alias("km"))


@query("spatial_block", duck("v_cells") + f"""SELECT {KEYS},
    {big('floor((lat + 90) / 10) * 36 + floor((lon + 180) / 10)', 'block')} FROM v_cells""")
def _(v):
    return v.cells.select("r", "c", G.spatial_block(F.col("lat"), F.col("lon")).alias("block"))


@query("region_filter", duck("v_cells", "v_regions") + f"""SELECT {bigs('r', 'c')}, region FROM v_cells JOIN v_regions
    ON lat BETWEEN s_lat AND n_lat AND lon BETWEEN w_lon AND e_lon""")
def _(v):
    return joins.region_join(v.cells, v.regions).select("r", "c", "region")


@query("land_mask", duck("v_cells") + f"""SELECT {KEYS} FROM v_cells WHERE frac IS NOT NULL AND pop >= 0
    AND excl BETWEEN 1 AND 6 AND excl <> 5 AND soil BETWEEN 1 AND 33""")
def _(v):
    mask = S.land_mask(F.col("pot_rain"), F.col("frac"), F.col("pop"), F.col("excl"), F.col("soil"))
    return v.cells.where(mask).select("r", "c")


@query("presence_flag", duck("v_cells") + f"SELECT {KEYS}, {big('CASE WHEN frac > 0.5 THEN 1 ELSE 0 END', 'presence')} FROM v_cells")
def _(v):
    return v.cells.select("r", "c", S.presence_flag(F.col("frac"), 0.5).alias("presence"))


@query("threshold_mask", duck("v_cells") + f"""SELECT {KEYS}, label, {big('CASE WHEN frac > t THEN 1 ELSE 0 END', 'reliable')}
    FROM v_cells, (VALUES ('0p1', 0.1), ('0p5', 0.5), ('1', 1.0)) AS th(label, t)""")
def _(v):
    return joins.threshold_mask(v.cells.select("r", "c", "frac"), "frac", [0.1, 0.5, 1.0]).select("r", "c", "label", "reliable")


@query("complete_cases", duck("v_cells") + f""", d AS (SELECT *, {DIRTY} AS x FROM v_cells)
    SELECT count(*) AS n_rows, count(x) AS n_complete, {r6('count(x) / count(*)', 'share')},
    {r6('avg(CASE WHEN x IS NOT NULL THEN frac END)', 'mean_frac')} FROM d""")
def _(v):
    d = dirty(v)
    kept = layers.complete_cases(d, ["x", "frac"]).agg(F.avg("frac")).scalar()
    return layers.retained_share(d, ["x", "frac"]).withColumn("mean_frac", kept)


@query("class_isin", duck("v_cells") + f"SELECT {KEYS}, CASE WHEN soil IN (3, 17, 33) THEN soil END AS soil FROM v_cells")
def _(v):
    return v.cells.select("r", "c", S.class_isin(F.col("soil"), [3, 17, 33]).alias("soil"))


@query("label_lookup", """SELECT s_suppkey, coalesce(CASE n_name WHEN 'NATION_0' THEN 'Zero Land' END, n_name, 'unknown') AS label
    FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
def _(v):
    names = v.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("label"))
    return joins.label_lookup(
        v.table("supplier"), names, "s_nationkey", "label", renames={"NATION_0": "Zero Land"}, unknown="unknown"
    ).select("s_suppkey", "label")


@query("prior_shift", duck("v_oof") + f""", k AS (SELECT *, least(greatest(p_cand, 1e-6), 1 - 1e-6) AS p FROM v_oof),
    o AS (SELECT id, p / (1 - p) * (0.2 / 0.8) / (0.5 / 0.5) AS odds FROM k)
    SELECT id, {r6('odds / (1 + odds)', 'p_cal')} FROM o""")
def _(v):
    return v.oof.select("id", S.prior_shift(F.col("p_cand"), F.lit(0.5), F.lit(0.2)).alias("p_cal"))


@query("expected_value", duck("v_oof") + f"SELECT id, {r6('p_base * least(greatest(p_cand, 0), 1)', 'expected')} FROM v_oof")
def _(v):
    return v.oof.select("id", S.expected_fraction(F.col("p_base"), F.col("p_cand")).alias("expected"))


FEATURE_NAMES = ("CASE l_linenumber % 4 WHEN 0 THEN 'slope' WHEN 1 THEN 'wx_50km_log_glofas_p10_2020' "
                 "WHEN 2 THEN 'log_rainfed_value_top5' ELSE 'soil_group' END")


@query("rename_feature_group", f"""WITH f AS (SELECT {FEATURE_NAMES} AS feature FROM lineitem)
    SELECT feature, CASE feature WHEN 'slope' THEN 'terrain_constraints' WHEN 'wx_50km_log_glofas_p10_2020' THEN 'water_resources'
    WHEN 'log_rainfed_value_top5' THEN 'rainfed_potential' ELSE 'other' END AS feature_group, count(*) AS n FROM f GROUP BY 1, 2""")
def _(v):
    features = v.table("lineitem").select(F.expr(FEATURE_NAMES).alias("feature"))
    return features.groupBy("feature", X.feature_group(F.col("feature")).alias("feature_group")).agg(F.count(F.lit(1)).alias("n"))


@query("parse_filename", """WITH f AS (SELECT p_partkey, 'global_area_A_' || 'CR' || p_size || CASE p_partkey % 3 WHEN 0 THEN '_A'
    WHEN 1 THEN '_I' ELSE '_R' END || '.tif' AS path FROM part)
    SELECT p_partkey, regexp_extract(path, '_A_([A-Z0-9]+)_([AIR])\\b', 1) AS crop,
    regexp_extract(path, '_A_([A-Z0-9]+)_([AIR])\\b', 2) AS production_system FROM f""")
def _(v):
    suffix = F.expr("CASE p_partkey % 3 WHEN 0 THEN '_A' WHEN 1 THEN '_I' ELSE '_R' END")
    path = F.concat(F.lit("global_area_A_CR"), F.col("p_size").cast("string"), suffix, F.lit(".tif"))
    crop, system = X.parse_filename(path)
    return v.table("part").select("p_partkey", crop.alias("crop"), system.alias("production_system"))


def _normalize_sql(expr: str) -> str:
    out = f"regexp_replace(regexp_replace(replace(regexp_replace(lower({expr}), '\\([^)]*\\)', ' ', 'g'), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '^$', '')"
    for old, new in X.CROP_SYNONYMS.items():
        if old != new:
            out = f"replace({out}, '{old}', '{new}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


RAW_NAMES = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' (Wetland) rice' WHEN 1 THEN ' Soybean & MAIZE' WHEN 2 THEN '_rapeseed' ELSE ' beans/Sunflower' END"


@query("normalize_text", f"WITH n AS (SELECT p_partkey, {RAW_NAMES} AS raw FROM part) SELECT p_partkey, {_normalize_sql('raw')} AS name FROM n")
def _(v):
    return v.table("part").select("p_partkey", X.normalize_text(F.expr(RAW_NAMES)).alias("name"))


RECHARGE_TEXT = ("p_name || CASE p_partkey % 5 WHEN 0 THEN ' Diffuse_Groundwater-Recharge' WHEN 1 THEN ' (qrswb)' "
                 "WHEN 2 THEN ' qr monthly' WHEN 3 THEN ' total-groundwater recharge' ELSE ' qrx' END")


@query("recharge_kind", f"""WITH t AS (SELECT p_partkey, regexp_replace(lower({RECHARGE_TEXT}), '[_-]', ' ', 'g') AS t FROM part)
    SELECT p_partkey, CASE WHEN t LIKE '%diffuse groundwater recharge%' OR t LIKE '%qrdif%' THEN 'diffuse'
    WHEN t LIKE '%qrswb%' OR t LIKE '%surface water body%' THEN 'surface_water_body'
    WHEN t LIKE '%total groundwater recharge%' OR regexp_matches(t, '\\bqr\\b') THEN 'total' END AS kind FROM t""")
def _(v):
    return v.table("part").select("p_partkey", X.recharge_kind(F.expr(RECHARGE_TEXT)).alias("kind"))
