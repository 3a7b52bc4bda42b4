"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.fixtures import duck
from gridspark.operators import joins as J
from gridspark.operators import names as M
from gridspark.plans.catalog import CHECKED_MAPPING
from gridspark.queries.registry import big, bigs, query, r6

RC = bigs("r", "c")


YEARS = range(1992, 1999)


@query("layer_stack", duck("v_cells", "v_cube") + f""", b AS (SELECT r, c, {', '.join(f"max(v) FILTER (WHERE yr = {y}) AS y{y}" for y in YEARS)}
    FROM v_cube GROUP BY r, c) SELECT {RC}, {r6('frac')}, {', '.join(r6(f'y{y}') for y in YEARS)} FROM v_cells LEFT JOIN b USING (r, c)""")
def _(v):
    cube = v.cube
    layers = {f"y{y}": cube.where(F.col("yr") == y).withColumnRenamed("v", "value") for y in YEARS}
    return J.gather(v.cells.select("r", "c", "frac"), layers)


ONE_TO_ONE = duck("v_cells") + f"SELECT {RC}, {r6('pot_rain')}, {r6('pop')} FROM v_cells"


@query("one_to_one_join", ONE_TO_ONE)
def _(v):
    cells = v.cells
    return J.checked_join(cells.select("r", "c", "pot_rain"), cells.select("r", "c", "pop"), ["r", "c"], expect_rows=cells.count())


@query("many_to_one_join", duck("v_oof", "v_cells") + f"SELECT id, {r6('y')}, {r6('frac')} FROM v_oof JOIN v_cells USING (r, c)")
def _(v):
    return J.checked_join(v.oof.select("r", "c", "id", "y"), v.cells.select("r", "c", "frac"), ["r", "c"], "m:1").select("id", "y", "frac")


@query("left_lookup_join", duck("v_oof", "v_cells") + f"SELECT id, {r6('pop')} FROM v_oof LEFT JOIN v_cells USING (r, c)")
def _(v):
    return J.lookup_join(v.oof.select("r", "c", "id"), v.cells.select("r", "c", "pop"), ["r", "c"]).select("id", "pop")


@query("inner_name_join", """WITH a AS (SELECT n_name AS country, count(*) AS suppliers FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1),
    b AS (SELECT CASE n_name WHEN 'Republic of 3' THEN 'NATION_3' ELSE n_name END AS country, customers FROM
      (SELECT CASE WHEN n_nationkey = 3 THEN 'Republic of 3' ELSE n_name END AS n_name, count(*) AS customers FROM customer
       JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)) SELECT * FROM a JOIN b USING (country)""")
def _(v):
    nation = v.table("nation")
    a = v.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("country")).agg(
        F.count(F.lit(1)).alias("suppliers")
    )
    spelled = F.when(F.col("n_nationkey") == 3, "Republic of 3").otherwise(F.col("n_name"))
    b = v.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(spelled.alias("country")).agg(
        F.count(F.lit(1)).alias("customers")
    )
    return J.name_join(a, b, "country", {"Republic of 3": "NATION_3"})


@query("region_theta_join", duck("v_oof", "v_regions") + f"""SELECT region, count(*) AS n, {r6('avg(y)', 'mean_y')} FROM v_oof JOIN v_regions
    ON lat BETWEEN s_lat AND n_lat AND lon BETWEEN w_lon AND e_lon GROUP BY region""")
def _(v):
    return J.region_join(v.oof, v.regions).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"))


@query("anti_unmatched", """SELECT DISTINCT p_brand AS crop FROM part WHERE p_brand NOT IN
    (SELECT p_brand FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity = 50 AND l_discount > 0.09 AND l_tax > 0.07)""")
def _(v):
    items = v.table("lineitem").where("l_quantity = 50 AND l_discount > 0.09D AND l_tax > 0.07D")
    parts = v.table("part").select(F.col("p_brand").alias("crop"), "p_partkey")
    known = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return J.unmatched(parts, known, "crop")


CROSSWALK = """WITH crops AS (SELECT DISTINCT p_type AS crop FROM part),
    m AS (SELECT DISTINCT p_type AS crop, p_brand AS target, CASE WHEN p_size < 3 THEN 0 WHEN p_size BETWEEN 10 AND 12 THEN 1
      WHEN p_size BETWEEN 20 AND 24 THEN 2 END AS k FROM part WHERE p_size < 3 OR p_size BETWEEN 10 AND 12 OR p_size BETWEEN 20 AND 24),
    l AS (SELECT crop, k, string_agg(target, ',' ORDER BY target) AS targets FROM m GROUP BY crop, k),
    b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY crop ORDER BY k) = 1)
    SELECT crop, CASE k WHEN 0 THEN 'composite' WHEN 1 THEN 'direct' WHEN 2 THEN 'proxy' ELSE 'unmatched' END AS rule, targets
    FROM crops LEFT JOIN b USING (crop)"""


@query("crosswalk_join", CROSSWALK)
def _(v):
    part = v.table("part").select(F.col("p_type").alias("crop"), F.col("p_brand").alias("target"), "p_size")
    maps = [("composite", part.where("p_size < 3")), ("direct", part.where("p_size BETWEEN 10 AND 12")), ("proxy", part.where("p_size BETWEEN 20 AND 24"))]
    return J.crosswalk(part, maps)


FUZZY = """WITH a AS (SELECT DISTINCT p_name AS name FROM part), b AS (SELECT DISTINCT p_type AS candidate FROM part),
    s AS (SELECT name, candidate, round(0.65 * (1 - levenshtein(name, candidate) / greatest(length(name), length(candidate), 1))
      + 0.35 * len(list_intersect(list_distinct(string_split(name, ' ')), list_distinct(string_split(candidate, ' '))))
        / len(list_distinct(list_concat(string_split(name, ' '), string_split(candidate, ' ')))), 9) AS score FROM a CROSS JOIN b),
    k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, candidate) AS n FROM s)"""


@query("fuzzy_best_match", FUZZY + f"SELECT name, candidate, {r6('score')}, round(score, 6) < 0.72 AS needs_manual_check FROM k WHERE n = 1")
def _(v):
    part = v.table("part")
    return M.fuzzy_best_match(part.select(F.col("p_name").alias("name")), part.select(F.col("p_type").alias("candidate")))


def _mapping_values() -> str:
    return ", ".join(f"('{code}', '{price}', '{calorie}')" for code, (price, calorie) in CHECKED_MAPPING.items())


# Items of the mapping in alphabetical order receive the statistics of one p_size each.
CHECKED = f"""WITH m AS (SELECT * FROM (VALUES {_mapping_values()}) t(code, price_item, calorie_item)),
    pi AS (SELECT price_item, row_number() OVER (ORDER BY price_item) AS k FROM (SELECT DISTINCT price_item FROM m)),
    ci AS (SELECT calorie_item, row_number() OVER (ORDER BY calorie_item) AS k FROM (SELECT DISTINCT calorie_item FROM m)),
    st AS (SELECT p_size AS k, avg(p_retailprice) AS price, count(*) AS n FROM part GROUP BY p_size)
    SELECT code, price_item, calorie_item, {r6('a.price', 'price')}, b.n AS n_calorie FROM m JOIN pi USING (price_item) JOIN ci USING (calorie_item)
    JOIN st a ON a.k = pi.k JOIN st b ON b.k = ci.k"""


@query("checked_mapping", CHECKED)
def _(v):
    mapping = v.spark.createDataFrame([(k, *pair) for k, pair in CHECKED_MAPPING.items()], "code string, price_item string, calorie_item string")
    stats = v.table("part").groupBy(F.col("p_size").alias("k")).agg(F.avg("p_retailprice").alias("price"), F.count(F.lit(1)).alias("n"))

    def keyed(index):
        items = sorted({pair[index] for pair in CHECKED_MAPPING.values()})
        return v.spark.createDataFrame([(i + 1, item) for i, item in enumerate(items)], "k int, item string").join(stats, "k")

    price = keyed(0).select(F.col("item").alias("price_item"), "price")
    calorie = keyed(1).select(F.col("item").alias("calorie_item"), F.col("n").alias("n_calorie"))
    return J.checked_mapping(mapping, price, calorie)


CODEBOOKS = f"""WITH a AS (SELECT p_name AS crop_name, min(p_brand) AS code FROM part GROUP BY 1), b AS (SELECT p_name AS crop_name, max(p_brand) AS code FROM part GROUP BY 1)
    SELECT crop_name, a.code AS code_a, b.code AS code_b, EXISTS (SELECT 1 FROM b o WHERE o.code = a.code AND o.crop_name <> ANY
      (SELECT i.crop_name FROM a i WHERE i.code = a.code)) AS code_reused FROM a JOIN b USING (crop_name)"""


@query("codebook_join", CODEBOOKS)
def _(v):
    part = v.table("part").withColumnRenamed("p_name", "crop_name")
    return J.codebook_join(
        part.groupBy("crop_name").agg(F.min("p_brand").alias("code")), part.groupBy("crop_name").agg(F.max("p_brand").alias("code"))
    )
