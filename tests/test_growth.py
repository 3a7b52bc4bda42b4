"""Work per task and number of passes don't grow with copies, groups or parts."""

from pyspark.sql import functions as F

from gridspark.models import share
from gridspark.operators import attribution, joins, ranking, resample


def test_rows_of_a_large_group_are_dealt_before_they_meet_their_edges(spark):
    df = spark.range(8000).select(F.when(F.col("id") < 7900, "a").otherwise("b").alias("f"), (F.col("id") % 100).cast("double").alias("x"))
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in own}
    for k, value in own.items():
        spark.conf.set(k, value)
    try:
        binned = ranking.quantile_bins(df.unionByName(spark.createDataFrame([("b", None), (None, 1.0)], "f string, x double")), "x", 10, ["f"], hot_rows=200)
        assert binned.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 4000
        got = {(r.f, r.bin): r["count"] for r in binned.groupBy("f", "bin").count().collect()}
    finally:
        for k, value in old.items():
            spark.conf.set(k, value)
    assert got == {(f, i): n for f, n in (("a", 790), ("b", 10)) for i in range(10)}


def test_relation_reads_the_rows_once(spark):
    rows = [("a", float(i), float(i * i % 7) + 1e6) for i in range(20)] + [("a", None, 2.0), ("a", 3.0, None), ("b", 1.0, -1.0), ("b", 1.0, -1.0), (None, 1.0, 1.0)]
    phi = spark.createDataFrame(rows, "feature string, x double, phi double")
    got = attribution.value_attribution_relation(phi.crossJoin(spark.range(3).select(F.col("id").alias("copy"))))
    assert "Range" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = phi.groupBy("feature").agg(F.corr("x", "phi").alias("r"), F.avg((F.col("phi") > 0).cast("double")).alias("s"), F.percentile("phi", 0.5).alias("p50"))
    want = {r.feature: r for r in want.where("feature = 'a'").collect()}
    found = {r.feature: r for r in got.collect()}
    assert set(found) == {"a", "b"}
    a = found["a"]
    assert abs(a.pearson - want["a"].r) < 1e-9 and a.share_positive == want["a"].s and a.n == 66
    assert found["b"].n == 6 and found["b"].p50 == -1.0 and found["b"].share_positive == 0.0 and found["b"].spearman is None


def test_few_boxes_move_no_rows(spark):
    cells = spark.range(5000).select("id", (F.col("id") % 170 - 85.0).alias("lat"), (F.col("id") % 350 - 175.0).alias("lon"))
    boxes = spark.createDataFrame([("a", -10.0, 40.0, 0.0, 30.0), ("b", 0.0, 2.0, 0.0, 2.0)], "region string, w_lon double, e_lon double, s_lat double, n_lat double")
    got = joins.region_join(cells, boxes)
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    pairs = lambda df: sorted((r.id, r.region) for r in df.collect())
    assert pairs(got) == pairs(joins.region_join(cells, boxes, hot_rows=100, few_boxes=0)) != []


def test_bootstrap_reads_the_rows_once(spark):
    df = spark.range(400).select((F.col("id") % 20).alias("block"), (F.col("id") % 3).cast("double").alias("y"), F.lit(1.0).alias("c"), F.lit(0.5).alias("r"))
    out = resample.block_bootstrap(df, "y", {"x": ("c", "r")}, "block", reps=50)
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first().n_blocks == 20


def test_trees_get_parts_by_their_rows(spark, monkeypatch):
    seen = []

    class Spy(share.GBTRegressor):
        def fit(self, dataset, params=None):
            seen.append(dataset.rdd.getNumPartitions())
            return super().fit(dataset, params)

    monkeypatch.setattr(share, "GBTRegressor", Spy)
    long = spark.range(400).select((F.col("id") % 10).alias("r"), F.floor(F.col("id") / 40).alias("c"), (F.floor(F.col("id") / 10) % 4).cast("string").alias("crop"),
                                   (F.col("id") % 17 / 17).alias("x"), (F.col("id") % 5 / 10).alias("y"), F.lit(1.0).alias("w")).repartition(30)
    out = share.softmax_share_tree(long.where("r < 8"), long.where("r >= 8"), ["x"], ["crop"], trees=2, max_depth=2)
    assert out.count() == 80
    assert seen == [1]
