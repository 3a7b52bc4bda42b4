"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridspark.queries import QUERIES  # noqa: E402
from gridspark.session import local_session  # noqa: E402

# One or two queries of every family; together they stay within a few minutes.
HEADLINE = (
    "river_reliability", "block_aggregate", "regrid_average", "annual_p10", "box_mean_km", "distance_to_mask", "knn_haversine", "morans_i",
    "layer_stack", "region_theta_join", "price_summary", "calorie_summary", "country_summary", "topk_mean", "dominant_crop", "crop_share",
    "regression_metrics", "metrics_by_group", "auc", "average_precision", "weighted_quantile", "quantile_bins", "spearman_corr",
    "case_control_sample", "block_bootstrap", "shap_group_summary", "group_shapley_exact", "feature_shapley_paired", "permutation_importance",
    "regional_change_metrics", "fractional_logit", "fuzzy_best_match", "two_stage_oof", "group_shapley_model", "em_fractional_mixture", "kmeans_regime_models",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "bench")
    times: dict[str, float] = {}
    QUERIES["scan_layer"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
