"""Samples, folds, weights and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.rng import hash_prefix, key_hash, uniform
from gridspark.functions.scalar import is_finite
from gridspark.operators.metrics import weighted_mean
from gridspark.operators.scan import EXACT, SPLIT_ROWS, exact_quantiles, first_n, numbered, running_sums

HASH = "_hash"


def prefix_bits(df: DataFrame, split_rows: int = SPLIT_ROWS) -> int:
    """Leading bits of a hash that cut a table of this many rows into ranges of at most about ``split_rows`` rows."""
    return max(6, (df.count() // split_rows).bit_length() + 1)


def _hash_first(df: DataFrame, key: str, n: Column | int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    hashed = df.withColumn(HASH, key_hash(F.col(key), seed))
    return first_n(hashed, HASH, [key], n, by, "sample_rank", bucket=hash_prefix(F.col(HASH), prefix_bits(df))).drop(HASH)


def case_control_sample(cells: DataFrame, key: str, presence: str, n_pos: int, n_zero: int, seed: int = 42) -> DataFrame:
    """Up to ``n_pos`` presences and ``n_zero`` absences without replacement, in hash order."""
    limit = F.when(F.col(presence) == 1, F.lit(n_pos)).otherwise(F.lit(n_zero))
    return _hash_first(cells, key, limit, seed, [presence])


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all) without replacement."""
    return _hash_first(df, key, n, seed)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, inclusion by weight (Gumbel top-n)."""
    u = uniform(key_hash(F.col(key), seed))
    gumbel = F.log(F.col(weight)) - F.log(-F.log(u))
    scored = df.where(F.col(weight) > 0).withColumn("_order", -F.round(gumbel, 9))
    return first_n(scored, "_order", [key], n, name="sample_rank").drop("_order")


def weighted_draw(pool: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` draws with replacement proportional to weight: (draw, key).

    Rows own stretches of the summed weight. Rows and draws meet in equal slices
    of it; a heavy row is listed once per slice it covers, so the list has at
    most one row more per slice.
    """
    slices = max(1, min(n, 1 << 20))
    held = pool.where(F.col(weight) > 0).select(key, F.col(weight).cast(EXACT).alias("_weight"))
    placed = running_sums(held, key, {"_end": "_weight"}, totals={"_total": "_weight"})
    end = F.col("_end").cast("double") / F.col("_total").cast("double")
    start = (F.col("_end") - F.col("_weight")).cast("double") / F.col("_total").cast("double")
    owned = placed.select(key, start.alias("_from"), end.alias("_to")).withColumn(
        "_slice", F.explode(F.sequence(F.floor(F.col("_from") * slices), F.least(F.floor(F.col("_to") * slices), F.lit(slices - 1).cast("long"))))
    )
    draws = pool.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(key_hash(F.col("id"), seed)).alias("_u"))
    keyed = draws.withColumn("_slice", F.floor(F.col("_u") * slices))
    hit = (F.col("_from") <= F.col("_u")) & (F.col("_u") < F.col("_to"))
    return keyed.join(owned, "_slice").where(hit).select("draw", key)


def lightest_fold_plan(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """How "largest group first, to the lightest fold" deals groups: (size, first rank, last rank + 1, folds in turn).

    ``sizes`` lists (size, number of groups). Folds lighter than the lightest one plus the size take turns, lightest first,
    until they reach the next fold; so a size needs at most ``k`` + 1 turns, however many groups it has.
    """
    loads, out = [0] * k, []
    for size, groups in sorted(sizes, reverse=True):
        rank = 0
        while rank < groups:
            order = sorted(range(k), key=lambda i: (loads[i], i))
            turn = [i for i in order if loads[i] < loads[order[0]] + size]
            rest = order[len(turn):]
            rounds = (loads[rest[0]] - loads[order[0]]) // size if rest else groups
            n = min(groups - rank, max(1, rounds) * len(turn))
            out.append((size, rank, rank + n, turn))
            for j, fold in enumerate(turn):
                loads[fold] += size * (n // len(turn) + (j < n % len(turn)))
            rank += n
    return out


def group_kfold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Fold per group: the largest group goes to the lightest fold, equal ones in the order of their keys.

    Only the numbers of groups of each size reach the driver, at most about the square root of twice the row count.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    histogram = [(r["_n"], r["_groups"]) for r in sizes.groupBy("_n").agg(F.count(F.lit(1)).alias("_groups")).collect()]
    plan = df.sparkSession.createDataFrame(lightest_fold_plan(histogram, k), "_size long, _from long, _to long, _turn array<int>")
    ranked = numbered(sizes, group, [], ["_n"], "_rank")
    rank = F.col("_rank") - 1
    dealt = ranked.join(plan, (F.col("_n") == F.col("_size")) & (rank >= F.col("_from")) & (rank < F.col("_to")))
    return dealt.select(group, F.get("_turn", F.pmod(rank - F.col("_from"), F.size("_turn")).cast("int")).alias("fold"))


def with_folds(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    return df.join(folds, group)


def group_shuffle_split(df: DataFrame, group: str, test: float = 0.25, seed: int = 42) -> DataFrame:
    """Groups with a test flag; ``ceil(test * groups)`` groups are test groups."""
    groups = df.select(group).distinct().withColumn(HASH, key_hash(F.col(group), seed))
    ranked = numbered(groups, HASH, [group], name="_rank", total="_groups")
    return ranked.select(group, (F.col("_rank") <= F.ceil(F.col("_groups") * F.lit(test))).alias("is_test"))


def target_prior(cells: DataFrame, mask: Column, presence: Column) -> DataFrame:
    """Presence share of all eligible cells."""
    return cells.where(mask).agg(F.avg(presence.cast("double")).alias("prior"), F.count(F.lit(1)).alias("n_eligible"))


def area_weight(sample: DataFrame, population: DataFrame, presence: str, area: str | None) -> DataFrame:
    """Weights that restore the population: class size ratio times cell area (1 without areas)."""
    if area is None:
        return sample.withColumn("weight", F.lit(1.0))
    n_pop = population.groupBy(presence).agg(F.count(F.lit(1)).alias("_pop"))
    n_sam = sample.groupBy(presence).agg(F.count(F.lit(1)).alias("_sam"))
    rates = n_sam.join(n_pop, presence).select(presence, (F.col("_pop") / F.col("_sam")).alias("_rate"))
    return sample.join(rates, presence).withColumn("weight", F.col("_rate") * F.col(area)).drop("_rate")


def normalize_weight(df: DataFrame, w: str) -> DataFrame:
    """Scale weights to mean 1."""
    mean = df.agg(F.avg(w)).scalar()
    return df.withColumn(w, F.col(w) / F.greatest(mean, F.lit(1e-12)))


def selection_reweight(sample: DataFrame, selected: Column, w: str, by: Sequence[str]) -> DataFrame:
    """Keep the selected rows and divide their weight by the share selected in their group."""
    rates = sample.groupBy(*by).agg(F.avg(selected.cast("double")).alias("_rate"))
    return sample.where(selected).join(rates, list(by)).withColumn(w, F.col(w) / F.col("_rate")).drop("_rate")


def regime_prior(train: DataFrame, regime: str, presence: str, w: str) -> DataFrame:
    """Weighted presence share per regime, the plain share where no weight is valid."""
    p = F.col(presence).cast("double")
    return train.groupBy(regime).agg(F.coalesce(weighted_mean(p, F.col(w)), F.avg(p)).alias("prior"), F.count(F.lit(1)).alias("n"))


def median_impute(df: DataFrame, col: str, flag: str = "imputed") -> DataFrame:
    """Fill missing values with the median of the valid ones and flag them."""
    ok = is_finite(F.col(col))
    median = exact_quantiles(df.select(F.when(ok, F.col(col)).alias(col)), col, {"m": 0.5}).scalar()
    return df.withColumn(flag, (~ok).cast("int")).withColumn(col, F.when(ok, F.col(col)).otherwise(median))


def zero_impute(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.when(is_finite(F.col(col)), F.col(col)).otherwise(F.lit(0.0)))
