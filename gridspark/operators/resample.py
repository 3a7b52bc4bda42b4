"""Block bootstrap and the rules that choose models from its results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.rng import index, key_hash
from gridspark.operators.scan import numbered
from gridspark.session import cut_lineage

# Support needed to call an improvement likely, and classes in order of strength.
LIKELY = 0.80


def block_errors(df: DataFrame, y: str, contrasts: Mapping[str, tuple[str, str]], block: str, by: Sequence[str] = ()) -> DataFrame:
    """Row count and squared-error sums of both models per block and contrast, in one pass."""
    se = lambda p: (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))
    sums = [F.count(F.lit(1)).alias("n")]
    for i, (candidate, reference) in enumerate(contrasts.values()):
        sums += [F.sum(se(candidate)).alias(f"_c{i}"), F.sum(se(reference)).alias(f"_r{i}")]
    wide = df.groupBy(*by, block).agg(*sums)
    parts = F.array(*[
        F.struct(F.lit(name).alias("contrast"), F.col(f"_c{i}").alias("sse_candidate"), F.col(f"_r{i}").alias("sse_reference"))
        for i, name in enumerate(contrasts)
    ])
    return wide.select(*by, block, "n", F.explode(parts).alias("p")).select(*by, block, "n", "p.*")


def block_bootstrap(df: DataFrame, y: str, contrasts: Mapping[str, tuple[str, str]], block: str, reps: int = 2000,
                    by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Paired bootstrap of the RMSE difference over spatial blocks.

    Cells are reduced to one row per block first, in one pass; each repetition then
    redraws block numbers, identical for all contrasts.
    """
    stats = cut_lineage(block_errors(df, y, contrasts, block, by))
    blocks = numbered(stats.select(*by, block).distinct(), block, [], by, "_at", total="n_blocks")
    draws = blocks.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).select(
        *by, "_rep", "n_blocks", (index(key_hash(F.col("_at") - 1, seed, F.col("_rep")), F.col("n_blocks")) + 1).alias("_at")
    )
    drawn = draws.groupBy(*by, "_rep", "n_blocks", "_at").agg(F.count(F.lit(1)).alias("_times"))
    placed = stats.join(blocks.drop("n_blocks"), [*by, block])
    joined = drawn.join(placed, [*by, "_at"])
    times = F.col("_times")
    per_rep = joined.groupBy(*by, "contrast", "_rep").agg(
        F.sum(times * F.col("n")).alias("_n"), F.sum(times * F.col("sse_candidate")).alias("_c"),
        F.sum(times * F.col("sse_reference")).alias("_r"), F.max("n_blocks").alias("n_blocks"),
    ).withColumn("_d", F.sqrt(F.col("_c") / F.col("_n")) - F.sqrt(F.col("_r") / F.col("_n")))
    # At most ``reps`` values per group reach one percentile.
    boot = per_rep.groupBy(*by, "contrast").agg(
        F.avg("_d").alias("bootstrap_mean_delta"), F.percentile("_d", F.lit(0.025)).alias("ci_low"),
        F.percentile("_d", F.lit(0.975)).alias("ci_high"), F.avg((F.col("_d") < 0).cast("double")).alias("probability_lower_rmse"),
        F.max("n_blocks").alias("n_blocks"),
    )
    point = stats.groupBy(*by, "contrast").agg(
        (F.sqrt(F.sum("sse_candidate") / F.sum("n")) - F.sqrt(F.sum("sse_reference") / F.sum("n"))).alias("delta_rmse")
    )
    return boot.join(point, [*by, "contrast"])


def improvement_class(is_reference: Column, ci_high: Column, probability: Column, improved: Column) -> Column:
    """Strength of evidence; the first rule that holds names the class."""
    return (
        F.when(is_reference, "reference")
        .when(ci_high < 0, "clear_improvement")
        .when(probability >= LIKELY, "likely_improvement")
        .when(improved, "point_estimate_improvement")
        .otherwise("no_improvement")
    )


def _per_model(regional: DataFrame) -> DataFrame:
    """Mean gain and number of improved regions of every model as two maps in one row."""
    per = regional.groupBy("model").agg(
        F.avg("rmse_improvement_vs_baseline").alias("gain"), F.sum(F.col("rmse_improved").cast("int")).alias("wins")
    )
    entry = lambda c: F.map_from_entries(F.collect_list(F.struct("model", c)))
    return per.agg(entry("gain").alias("gain"), entry("wins").alias("wins"))


def forward_select(regional: DataFrame, additions: Mapping[str, str], pair: tuple[str, Sequence[str]], variants: Sequence[str],
                   baseline: str = "baseline", min_regions: int = 2) -> DataFrame:
    """Which additions and which variant to combine into one model.

    An addition stays when its mean gain is positive and enough regions improve.
    The pair replaces its members when it passes the same test and beats each of
    them. A variant replaces the baseline only with a positive mean gain.
    """
    gain = lambda m: F.coalesce(F.try_element_at("gain", F.lit(m)), F.lit(float("-inf")))
    passes = lambda m: (gain(m) > 0) & (F.coalesce(F.try_element_at("wins", F.lit(m)), F.lit(0)) >= min_regions)
    pair_model, members = pair
    singles = [m for m, f in additions.items() if f in members]
    pair_wins = passes(pair_model) & (gain(pair_model) > F.greatest(*[gain(m) for m in singles]))
    chosen = F.array(*[
        F.when(passes(m) | (pair_wins if f in members else F.lit(False)), F.lit(f)) for m, f in additions.items()
    ])
    best = F.array_max(F.array(*[
        F.struct(gain(m).alias("g"), F.lit(-i).alias("first"), F.lit(m).alias("m")) for i, m in enumerate(variants)
    ]))
    return _per_model(regional).select(
        F.when(best["g"] > 0, best["m"]).otherwise(baseline).alias("selected_variant"),
        F.array_join(F.array_compact(chosen), "|").alias("selected_additions"),
    )


def evidence_select(metrics: DataFrame, boot: DataFrame, start: tuple[str, str], candidates: Sequence[tuple[str, str, str]],
                    extension: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Switch only on evidence: a lower RMSE and a confidence interval below zero.

    ``start`` is (label, model), each candidate (label, model, contrast) is tested
    against the current choice in turn, and ``extension`` maps a label to the
    (model, contrast) of its extended variant.
    """
    rmse_map = metrics.agg(F.map_from_entries(F.collect_list(F.struct("model", "rmse"))).alias("rmse"))
    high_map = boot.agg(F.map_from_entries(F.collect_list(F.struct("contrast", "ci_high")))).scalar()
    row = rmse_map.withColumn("high", high_map).select(
        "*", F.lit(start[0]).alias("choice"), F.lit(start[1]).alias("model")
    )
    rmse = lambda m: F.try_element_at("rmse", m)
    high = lambda c: F.try_element_at("high", c)
    for label, model, contrast in candidates:
        better = F.coalesce((rmse(F.lit(model)) < rmse(F.col("model"))) & (high(F.lit(contrast)) < 0), F.lit(False))
        row = row.withColumn("_b", better).withColumns({
            "choice": F.when(F.col("_b"), label).otherwise(F.col("choice")), "model": F.when(F.col("_b"), model).otherwise(F.col("model")),
        })
    ext_model, ext_contrast = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, (model, contrast) in extension.items():
        ext_model = F.when(F.col("choice") == label, model).otherwise(ext_model)
        ext_contrast = F.when(F.col("choice") == label, contrast).otherwise(ext_contrast)
    extend = F.coalesce((rmse(ext_model) < rmse(F.col("model"))) & (high(ext_contrast) < 0), F.lit(False))
    return row.withColumn("extended", extend).withColumn("_m", ext_model).select(
        "choice", "extended", F.when(F.col("extended"), F.col("_m")).otherwise(F.col("model")).alias("selected_model")
    )
