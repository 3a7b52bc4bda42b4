"""A cell's background draws are averaged without a shuffle of their own."""

from pyspark.sql import functions as F

from gridspark.operators import shapley as H


def test_draws_hash_once_and_shuffle_cells_only(spark):
    cells = spark.range(500).select("id", (F.col("id") / 500).alias("a"), (F.col("id") % 7 / 7).alias("b"), F.lit(1.0).alias("w"))
    pool = H.background_pool(cells, "id", "w", ["a", "b"], 16)
    phi = H.group_shapley(cells, "id", {"a": ["a"], "b": ["b"]}, lambda x: x["a"] * x["b"], pool, 16, 8)
    plan = phi._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1
    assert phi._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert phi.where("abs(baseline + phi__a + phi__b - prediction) > 1e-12").count() == 0


def test_stages_share_their_draws(spark):
    cells = spark.range(200).select("id", (F.col("id") / 200).alias("a"), (F.col("id") % 7 / 7).alias("b"), F.lit(1.0).alias("w"))
    pool = H.background_pool(cells, "id", "w", ["a", "b"], 16)
    stages = {"product": lambda x: x["a"] * x["b"], "sum": lambda x: x["a"] + x["b"]}
    long = H.stage_interactions(cells, "id", {"a": ["a"], "b": ["b"]}, stages, pool, 16, 4)
    assert long._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert long.count() == 400
    assert long.where("stage = 'sum' AND abs(interaction) > 1e-12").count() == 0
    alone = H.shapley_interaction(H.coalition_values(cells, "id", {"a": ["a"], "b": ["b"]}, stages["product"], pool, 16, 4), ["a", "b"], ["id"])
    assert long.where("stage = 'product'").join(alone, "id").where("abs(interaction - a__b) > 1e-12").count() == 0


def test_interactions_are_kept_and_joined_as_one_row_a_cell(spark):
    """Neither the checkpoint nor the join with the cells' values multiplies the cells by the pairs."""
    cells = spark.range(40).select("id", (F.col("id") % 5 / 5).alias("a"), (F.col("id") % 7 / 7).alias("b"), (F.col("id") % 3 / 3).alias("c"), F.lit(1.0).alias("w"))
    pool = H.background_pool(cells, "id", "w", ["a", "b", "c"], 16)
    args = cells, "id", {f: [f] for f in "abc"}, {"s": lambda x: x["a"] * x["b"] + x["c"], "t": lambda x: x["b"] * x["c"]}, pool, 16, 4
    long = H.stage_interactions(*args, stored=True)
    assert "_i5" in long._jdf.queryExecution().analyzed().toString()
    rows = lambda df: sorted((r["id"], r["stage"], r["first"], r["second"], round(r["interaction"], 12)) for r in df.collect())
    assert rows(long) == rows(H.stage_interactions(*args)) and long.count() == 240
    top = H.top_interactions(long, 2)
    twice = cells.unionByName(cells.where("id = 3")).unionByName(cells.where("id = 4").withColumn("id", F.lit(None).cast("long")))
    got = H.pair_values(long, top, twice, "id", ["a", "b", "c"])
    want = long.join(top.select("stage", "first", "second", "rank"), ["stage", "first", "second"]).join(twice, "id")
    pick = lambda name: F.when(F.col(name) == "a", F.col("a")).when(F.col(name) == "b", F.col("b")).otherwise(F.col("c"))
    want = want.select("id", "stage", "rank", "first", "second", pick("first").alias("x"), pick("second").alias("color"), "interaction")
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() == 4 * 41
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_e") < plan.index("Aggregate [id")
