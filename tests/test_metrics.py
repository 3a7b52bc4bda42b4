"""Metrics beside a baseline."""

import random

from pyspark.sql import functions as F

from gridspark.operators import metrics as M


def test_the_baseline_has_no_gain_over_itself(spark):
    """Also where metrics, computed twice, would differ in their last digits."""
    noisy = F.udf(lambda: 0.5 + random.random() * 1e-12, "double").asNondeterministic()
    rows = spark.createDataFrame([(m, r) for m in ("base", "cand") for r in ("a", "b", None)], "model string, region string")
    metrics = rows.withColumns({c: noisy() for c in ("rmse", "mae", "r2")})
    for by in (["region"], []):
        got = [r for r in M.metric_deltas(metrics.where("region = 'a'") if not by else metrics, "base", by).collect() if r.model == "base"]
        assert len(got) == (2 if by else 1)
        assert all(r.rmse_improvement_vs_baseline == r.mae_improvement_vs_baseline == r.r2_gain_vs_baseline == 0 and not r.rmse_improved for r in got)
