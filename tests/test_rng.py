"""The portable hash behaves like independent uniform draws, and what rests on it has the spread of theory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import rng
from gridspark.operators import resample, sampling, shapley

N = 20_000


@pytest.fixture(scope="module")
def draws(spark):
    ids = spark.range(N)
    h = lambda *salts: rng.key_hash(F.col("id"), *salts)
    return ids.select("id", h(42).alias("h"), *[rng.uniform(h(42, r)).alias(f"u{r}") for r in range(4)], rng.index(h(7), 648).alias("ix")).toPandas()


def test_uniform_and_remainders(draws):
    for r in range(4):
        u = draws[f"u{r}"].to_numpy()
        assert 0 < u.min() and u.max() < 1
        counts = np.histogram(u, bins=50, range=(0, 1))[0]
        assert ((counts - N / 50) ** 2 / (N / 50)).sum() < 95  # chi-square with 49 degrees, p about 1e-4
    for k in (2, 4, 8):
        counts = np.bincount(draws.h % k, minlength=k)
        assert ((counts - N / k) ** 2 / (N / k)).sum() < 30
    assert draws.h.is_unique


def test_repetitions_are_independent(draws):
    for a in range(4):
        for b in range(a):
            assert abs(np.corrcoef(draws[f"u{a}"], draws[f"u{b}"])[0, 1]) < 0.03
            # no constant difference, as an affine hash would have
            assert np.unique(np.round((draws[f"u{a}"] - draws[f"u{b}"]) % 1, 6)).size > N * 0.9
    assert abs(np.corrcoef(draws.u0[:-1], draws.u0[1:])[0, 1]) < 0.03


def test_far_keys_do_not_collide(spark):
    rows = spark.range(1000).select(rng.key_hash(F.col("id"), 42).alias("a"), rng.key_hash(F.col("id") + (1 << 31), 42).alias("b")).toPandas()
    assert len(set(rows.a) | set(rows.b)) == 2000


def test_driver_twin(spark):
    row = spark.range(1).select(rng.key_hash(F.lit(12345), 42, F.lit(7)).alias("h"), rng.key_hash(F.lit(None).cast("long"), 42).alias("n")).first()
    assert row["h"] == rng.portable_hash(12345, 42, 7) and row["n"] is not None


def test_bootstrap_spread_agrees_with_theory(spark):
    rng_np = np.random.default_rng(3)
    blocks = 400
    error = rng_np.gamma(2.0, 1.0, blocks)
    rows = [(i, 0.0, float(np.sqrt(e)), 0.0) for i, e in enumerate(error)]
    df = spark.createDataFrame(rows, "block long, y double, c double, r double")
    out = resample.block_bootstrap(df, "y", {"x": ("c", "r")}, "block", reps=2000).first()
    # the candidate's RMSE is the root of a mean of unit errors: its standard error by the delta method
    se = error.std() / np.sqrt(blocks) / (2 * np.sqrt(error.mean()))
    assert out["ci_high"] - out["ci_low"] == pytest.approx(2 * 1.96 * se, rel=0.05)


def test_greedy_folds_equal_the_plain_rule(spark):
    for seed, sizes in ((0, [1] * 40), (1, [50, 50, 7, 7, 7, 3, 1, 1, 1, 1]), (2, [100, *[1] * 333]), (3, list(np.random.default_rng(5).integers(1, 60, 500)))):
        loads, want = [0] * 5, []
        for s in sorted(sizes, reverse=True):
            fold = loads.index(min(loads))
            loads[fold] += s
            want.append((s, fold))
        values, counts = np.unique(sizes, return_counts=True)
        got = []
        for size, start, stop, turn in sampling.lightest_fold_plan(list(zip(values.tolist(), counts.tolist())), 5):
            got += [(size, turn[i % len(turn)]) for i in range(stop - start)]
        assert got == [(int(a), b) for a, b in want], seed


def test_moves_are_permutations_and_differ():
    for n in (1, 2, 7, 360, 1001):
        moved = [tuple((f % n * i + s) % n for i in range(n)) for _, _, f, s in shapley.seat_moves(3, 4, 42)]
        assert all(sorted(m) == list(range(n)) for m in moved)
        if n > 100:
            assert len(set(moved)) == 12


def test_key_index_is_the_index_of_the_hash_and_never_null(spark):
    from gridspark.functions.rng import index, key_hash, key_index

    df = spark.sql("SELECT CASE WHEN id % 50 = 0 THEN NULL ELSE id END AS k, id % 32 AS d FROM range(2000)")
    for n in (1, 2, 64, 100, 4096, 1 << 20):
        both = df.select(key_index(F.col("k"), n, 42, F.col("d")).alias("a"), index(key_hash(F.col("k"), 42, F.col("d")), n).alias("b"))
        assert both.where("a <> b OR b IS NULL").count() == 0
        assert not both.schema["a"].nullable
