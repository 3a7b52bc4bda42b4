"""Shapley values and permutation importance for any score.

A score is either a function from a mapping of feature Columns to a Column, in
which case coalitions are scored side by side inside one row, or a function
from a DataFrame to the same DataFrame with a ``score`` column (a fitted
pipeline), in which case coalitions become rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.rng import hash_prefix, key_hash, key_index, portable_hash
from gridspark.operators.sampling import prefix_bits, weighted_draw
from gridspark.operators.ranking import quantile_bins
from gridspark.operators.scan import numbered
from gridspark.session import cut_lineage

ColumnScore = Callable[[Mapping[str, Column]], Column]
FrameScore = Callable[[DataFrame], DataFrame]
# Background rows go to every task.
MAX_POOL = 100_000


def background_pool(train: DataFrame, key: str, weight: str, features: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` background rows drawn in proportion to weight, numbered from 0.

    The rows are checkpointed once; there are ``n`` of them, so every use may broadcast them.
    """
    if n > MAX_POOL:
        raise ValueError(f"a background pool has at most {MAX_POOL} rows")
    drawn = weighted_draw(train, key, weight, n, seed)
    values = train.select(key, *features)
    return cut_lineage(drawn.join(values, key).select(F.col("draw").alias("_bg"), *[F.col(f).alias(f"b_{f}") for f in features]))


def _with_background(cells: DataFrame, key: str, features: Sequence[str], pool: DataFrame, n_pool: int, draws: int, seed: int,
                     keep: Sequence[str] = ()) -> DataFrame:
    """Every cell once per draw next to its own random background row.

    Cells are dealt by their key before they are multiplied, so that the mean of a cell's draws needs no shuffle.
    """
    spread = cells.select(key, *keep, *features).repartition(F.col(key)).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picked = spread.withColumn("_bg", key_index(F.col(key), n_pool, seed, F.col("_draw")))
    return picked.join(F.broadcast(pool), "_bg")


def _hybrid(features: Sequence[str], from_cell: Callable[[str], Column | bool]) -> dict[str, Column]:
    out = {}
    for f in features:
        take = from_cell(f)
        if isinstance(take, bool):
            out[f] = F.col(f) if take else F.col(f"b_{f}")
        else:
            out[f] = F.when(take, F.col(f)).otherwise(F.col(f"b_{f}"))
    return out


def _group_index(groups: Mapping[str, Sequence[str]]) -> dict[str, int]:
    return {f: i for i, members in enumerate(groups.values()) for f in members}


def coalition_values(cells: DataFrame, key: str, groups: Mapping[str, Sequence[str]], score: ColumnScore, pool: DataFrame, n_pool: int,
                     draws: int, seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """Mean score of every coalition of groups (``v0`` ... ``v<2**n - 1>``) per cell.

    All coalitions of a draw are scored in one row, and a cell's draws are averaged in the task that made them.
    """
    return _stage_values(cells, key, groups, {"": score}, pool, n_pool, draws, seed, keep)


def _stage_values(cells: DataFrame, key: str, groups: Mapping[str, Sequence[str]], stages: Mapping[str, ColumnScore], pool: DataFrame, n_pool: int,
                  draws: int, seed: int, keep: Sequence[str]) -> DataFrame:
    """The same under several scores over one draw of the background: ``<stage>v0`` and so on."""
    at = _group_index(groups)
    features = list(at)
    paired = _with_background(cells, key, features, pool, n_pool, draws, seed, keep)
    values = {
        f"{stage}v{mask}": score(_hybrid(features, lambda f, m=mask: bool(m >> at[f] & 1)))
        for stage, score in stages.items() for mask in range(1 << len(groups))
    }
    scored = paired.select(key, *keep, *[v.alias(name) for name, v in values.items()])
    return scored.groupBy(key, *keep).agg(*[F.avg(f"`{name}`").alias(name) for name in values])


def coalition_values_frame(cells: DataFrame, key: str, groups: Mapping[str, Sequence[str]], score: FrameScore, pool: DataFrame, n_pool: int,
                           draws: int, seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """The same for a fitted model: one row per coalition is scored and folded back."""
    at = _group_index(groups)
    features = list(at)
    n_masks = 1 << len(groups)
    paired = _with_background(cells, key, features, pool, n_pool, draws, seed, keep)
    masked = paired.withColumn("_mask", F.explode(F.sequence(F.lit(0), F.lit(n_masks - 1))))
    bit = lambda f: F.col("_mask").bitwiseAND(F.lit(1 << at[f])) != 0
    hybrid = masked.select(key, *keep, "_mask", *[c.alias(f) for f, c in _hybrid(features, bit).items()])
    return score(hybrid).groupBy(key, *keep).agg(
        *[F.avg(F.when(F.col("_mask") == m, F.col("score"))).alias(f"v{m}") for m in range(n_masks)]
    )


def shapley_from_values(values: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Exact Shapley values from coalition means, with baseline and prediction."""
    n = len(names)
    out = []
    for i, name in enumerate(names):
        terms = [
            F.lit(math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n)) * (F.col(f"v{m | 1 << i}") - F.col(f"v{m}"))
            for m in range(1 << n) if not m >> i & 1
            for s in [m.bit_count()]
        ]
        out.append(reduce(lambda a, b: a + b, terms).alias(f"phi__{name}"))
    return values.select(*keep, F.col("v0").alias("baseline"), F.col(f"v{(1 << n) - 1}").alias("prediction"), *out)


def group_shapley(cells: DataFrame, key: str, groups: Mapping[str, Sequence[str]], score: ColumnScore, pool: DataFrame, n_pool: int,
                  draws: int = 32, seed: int = 42) -> DataFrame:
    """Exact group Shapley values per cell; baseline plus values equals the prediction."""
    return shapley_from_values(coalition_values(cells, key, groups, score, pool, n_pool, draws, seed), list(groups), [key])


def group_shapley_frame(cells: DataFrame, key: str, groups: Mapping[str, Sequence[str]], score: FrameScore, pool: DataFrame, n_pool: int,
                        draws: int = 32, seed: int = 42) -> DataFrame:
    return shapley_from_values(coalition_values_frame(cells, key, groups, score, pool, n_pool, draws, seed), list(groups), [key])


def shapley_interaction(values: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Shapley interaction index of every pair of groups per cell."""
    terms = shapley_terms({m: F.col(f"v{m}") for m in range(1 << len(names))}, names)
    return values.select(*keep, *[x.alias(f"{a}__{b}") for (a, b), x in terms.items()])


def shapley_terms(value: Mapping[int, Column], names: Sequence[str]) -> dict[tuple[str, str], Column]:
    """The interaction index of every pair from the values of all coalitions."""
    n = len(names)
    out = {}
    for i, j in combinations(range(n), 2):
        both = 1 << i | 1 << j
        terms = [
            F.lit(math.factorial(s) * math.factorial(n - s - 2) / math.factorial(n - 1))
            * (value[m | both] - value[m | 1 << i] - value[m | 1 << j] + value[m])
            for m in range(1 << n) if not m & both
            for s in [m.bit_count()]
        ]
        out[names[i], names[j]] = reduce(lambda a, b: a + b, terms)
    return out


def interaction_summary(interactions: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Mean strength of each pair, strongest first."""
    pairs = [c for c in interactions.columns if c not in keep]
    long = interactions.unpivot(list(keep), pairs, "pair", "value")
    return long.groupBy("pair").agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean_signed"))


def stage_interactions(cells: DataFrame, key: str, groups: Mapping[str, Sequence[str]], stages: Mapping[str, ColumnScore], pool: DataFrame, n_pool: int,
                       draws: int = 32, seed: int = 42, keep: Sequence[str] = (), stored: bool = False) -> DataFrame:
    """key, keep, stage, first, second, interaction: the Shapley interaction of every pair of groups under each stage's score.

    A cell's coalitions of all pairs and stages come from one average over its draws. With ``stored`` they are checkpointed as one
    row per cell, numbers only, for several uses of the long table."""
    names = list(groups)
    values = _stage_values(cells, key, groups, {f"{i}_": score for i, score in enumerate(stages.values())}, pool, n_pool, draws, seed, keep)
    n = 1 << len(names)
    labels, terms = [], []
    for i, stage in enumerate(stages):
        for (a, b), x in shapley_terms({m: F.col(f"{i}_v{m}") for m in range(n)}, names).items():
            labels.append((stage, a, b))
            terms.append(x)
    wide = values.select(key, *keep, *[x.alias(f"_i{j}") for j, x in enumerate(terms)])
    if stored:
        wide = cut_lineage(wide)
    entries = [
        F.struct(F.lit(stage).alias("stage"), F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"_i{j}").alias("interaction"))
        for j, (stage, a, b) in enumerate(labels)
    ]
    return wide.select(key, *keep, F.explode(F.array(*entries)).alias("_e")).select(key, *keep, "_e.*")


def top_interactions(long: DataFrame, n: int, fold: str | None = None) -> DataFrame:
    """stage, first, second, mean_abs, mean_signed, n, rank: the ``n`` strongest pairs of every stage.

    Strengths are means over rows, or the mean of the folds' means. Ties in nine decimals go to the first names."""
    pair = ["stage", "first", "second"]
    mean = [F.avg(F.abs("interaction")).alias("mean_abs"), F.avg("interaction").alias("mean_signed"), F.count("interaction").alias("n")]
    table = long.groupBy(*pair, *([fold] if fold else [])).agg(*mean)
    if fold:
        table = table.groupBy(*pair).agg(F.avg("mean_abs").alias("mean_abs"), F.avg("mean_signed").alias("mean_signed"), F.sum("n").alias("n"))
    order = Window.partitionBy("stage").orderBy(F.desc(F.round("mean_abs", 9)), "first", "second")
    return table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def pair_values(long: DataFrame, top: DataFrame, cells: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """key, stage, first, second, x, color, interaction: a top pair's interaction beside the values of its two features.

    The top pairs, as many as were asked for, are broadcast; a cell's interactions meet its values as one row of numbers."""
    pairs = F.broadcast(top.select("stage", "first", "second", "rank", F.row_number().over(Window.orderBy("stage", "rank", "first", "second")).alias("_pair")))
    wanted = long.join(pairs.drop("rank"), ["stage", "first", "second"])
    listed = wanted.groupBy(key).agg(F.collect_list(F.struct("_pair", "interaction")).alias("_e"))
    own = cells.select(key, *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])
    joined = listed.join(own, key).select(key, *own.columns[1:], F.explode("_e").alias("_e")).join(pairs, F.col("_e._pair") == F.col("_pair"))
    value = lambda name: F.coalesce(*[F.when(F.col(name) == f, F.col(f"_f{i}")) for i, f in enumerate(features)])
    return joined.select(key, "stage", "rank", "first", "second", value("first").alias("x"), value("second").alias("color"), F.col("_e.interaction").alias("interaction"))


def pair_dependence(values: DataFrame, n_bins: int = 10) -> DataFrame:
    """stage, first, second, bin, color_bin, n, x, interaction: means over quantile bins of the first value and halves of the second."""
    pair = ["stage", "first", "second"]
    binned = quantile_bins(quantile_bins(values, "x", n_bins, pair), "color", 2, pair, "color_bin")
    return binned.groupBy(*pair, "bin", "color_bin").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("interaction").alias("interaction"))


def paired_permutations(n_features: int, n_perm: int, seed: int = 42) -> list[list[int]]:
    """Feature orders in pairs: a random one and its reverse."""
    orders = []
    for pair in range(n_perm // 2):
        order = sorted(range(n_features), key=lambda j: (portable_hash(j, seed, pair), j))
        orders += [order, order[::-1]]
    return orders


def _permuted(cells, key, features, pool, n_pool, n_perm, seed):
    """Cell x permutation rows with each feature's position; a pair shares one background row."""
    orders = paired_permutations(len(features), n_perm, seed)
    sides = [F.array(*[F.array(*[F.lit(order.index(j) + 1) for j in range(len(features))]) for order in orders[i:i + 2]]) for i in range(0, len(orders), 2)]
    paired = _with_background(cells, key, features, pool, n_pool, n_perm // 2, seed)
    exploded = paired.withColumn("_pos", F.explode(F.get(F.array(*sides), F.col("_draw"))))
    return exploded.select("*", *[F.col("_pos")[j].alias(f"_pos{j}") for j in range(len(features))])


def feature_shapley(cells: DataFrame, key: str, features: Sequence[str], score: ColumnScore, pool: DataFrame, n_pool: int,
                    n_perm: int = 32, seed: int = 42) -> DataFrame:
    """Feature Shapley values by antithetic permutations.

    One row holds a whole permutation: features switch from background to cell
    in order, and each is credited with the change of the score at its step.
    """
    rows = _permuted(cells, key, features, pool, n_pool, n_perm, seed)
    at = {f: j for j, f in enumerate(features)}
    scores = [
        score(_hybrid(features, lambda f, k=k: F.col(f"_pos{at[f]}") <= k) if 0 < k < len(features) else _hybrid(features, lambda f, k=k: k > 0))
        for k in range(len(features) + 1)
    ]
    stepped = rows.select(key, *[f"_pos{j}" for j in range(len(features))], F.array(*scores).alias("_s"))
    credit = [
        F.avg(F.col("_s")[F.col(f"_pos{j}")] - F.col("_s")[F.col(f"_pos{j}") - 1]).alias(f"phi__{f}") for f, j in at.items()
    ]
    return stepped.groupBy(key).agg(
        F.avg(F.col("_s")[0]).alias("baseline"), F.avg(F.col("_s")[len(features)]).alias("prediction"), *credit
    )


def feature_shapley_frame(cells: DataFrame, key: str, features: Sequence[str], score: FrameScore, pool: DataFrame, n_pool: int,
                          n_perm: int = 32, seed: int = 42) -> DataFrame:
    """The same for a fitted model: every step is a row; credits are differences of two means.

    The mean over permutations of (score after - score before) equals the mean
    score over the rows where the feature just switched minus that one step earlier.
    """
    n = len(features)
    at = {f: j for j, f in enumerate(features)}
    rows = _permuted(cells, key, features, pool, n_pool, n_perm, seed).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    hybrid = _hybrid(features, lambda f: F.col(f"_pos{at[f]}") <= F.col("_k"))
    scored = score(rows.select(key, "_k", *[f"_pos{j}" for j in range(n)], *[c.alias(f) for f, c in hybrid.items()]))
    s, k = F.col("score"), F.col("_k")
    credit = [
        (F.avg(F.when(k == F.col(f"_pos{j}"), s)) - F.avg(F.when(k == F.col(f"_pos{j}") - 1, s))).alias(f"phi__{f}") for f, j in at.items()
    ]
    return scored.groupBy(key).agg(F.avg(F.when(k == 0, s)).alias("baseline"), F.avg(F.when(k == n, s)).alias("prediction"), *credit)


def primes_from(start: int, n: int) -> list[int]:
    """The first ``n`` primes from ``start`` on."""
    out = []
    while len(out) < n:
        if all(start % d for d in range(2, math.isqrt(start) + 1)):
            out.append(start)
        start += 1
    return out


def seat_moves(n_groups: int, reps: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(group, repetition, factor, shift): the row on seat i gives to seat (factor * i + shift) modulo the number of seats.

    Seats are in hash order, so a move pairs rows at random; a prime factor makes it a permutation of the seats.
    """
    factors = primes_from(1 << 31, n_groups * reps)
    return [(g, r, factors[g * reps + r], portable_hash(seed, r + 1, g + 1)) for g in range(n_groups) for r in range(reps)]


#: Seats up to which the product of two of them fits a long.
LONG_SEATS = 3_000_000_000


def _sent_type(df: DataFrame, features: Sequence[str]) -> str:
    """Doubles where every feature fits one, else strings; both give back what they were given."""
    numbers = {"double", "float", "int", "smallint", "tinyint"}
    return "double" if {df.schema[f].dataType.simpleString() for f in features} <= numbers else "string"


#: Seats of a fold that one task deals to.
BLOCK_SEATS = 1 << 17


def _times(seat: np.ndarray, by: int, n: int) -> np.ndarray:
    if n < LONG_SEATS:
        return seat * by % n
    return np.array([int(i) * by % n for i in seat], dtype=np.int64)


def _factor(n: int, factor: int) -> int:
    # A factor that divides the number of seats would not be a permutation; the shift alone is one.
    return 1 if factor % n == 0 else factor % n


def _receivers(seat: np.ndarray, n: int, factor: int, shift: int) -> np.ndarray:
    """The seats that ``seat`` gives to."""
    return (_times(seat, _factor(n, factor), n) + shift % n) % n


def _givers(seat: np.ndarray, n: int, factor: int, shift: int) -> np.ndarray:
    """The seats that give to ``seat``."""
    return _times((seat - shift % n) % n, pow(_factor(n, factor), -1, n), n)


def _deal(members: Sequence[Sequence[int]], moves: Sequence[tuple[int, int, int, int]], block: int):
    """Parcels of a block of givers: for every move and block of takers, the givers' values in the order of their seats."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("_at")
        seat, n = table["_at"].to_numpy(), table["_seats"][0].as_py()
        first, out = int(seat[0]), []
        for g, rep, factor, shift in moves:
            to = _receivers(seat, n, factor, shift) // block
            order = np.argsort(to, kind="stable")
            blocks, starts = np.unique(to[order], return_index=True)
            offsets = pa.array(np.append(starts, len(to)).astype(np.int32))
            values = [table[f"_v{i}"].take(order).combine_chunks() for i in members[g]]
            empty = pa.nulls(len(blocks), pa.list_(values[0].type))
            lists = [pa.ListArray.from_arrays(offsets, v) for v in values]
            lists += [empty] * (max(map(len, members)) - len(lists))
            size = len(blocks)
            fixed = [pa.array(np.full(size, x, np.int32)) for x in (g, rep)]
            out.append(pa.table([
                table["_fold"].combine_chunks().take(np.zeros(size, np.int64)), pa.array(blocks), *fixed, pa.array(np.full(size, first)), *lists,
            ], names=["_fold", "_to", "g", "rep", "_first", *[f"p{i}" for i in range(len(lists))]]))
        return pa.concat_tables(out)

    return run


def _take(members: Sequence[Sequence[int]], moves: Sequence[tuple[int, int, int, int]], reps: int):
    """The rows of a block of takers, each with its values of every move: one list per feature, in the order of repetitions."""

    def run(takers: pa.Table, parcels: pa.Table) -> pa.Table:
        takers, parcels = takers.combine_chunks(), parcels.combine_chunks().sort_by("_first").combine_chunks()
        seat, n = takers["_at"].to_numpy(), takers["_seats"][0].as_py()
        which = parcels["g"].to_numpy() * reps + parcels["rep"].to_numpy()
        columns: dict[int, list] = {}
        for g, rep, factor, shift in moves:
            mine = pa.array(np.flatnonzero(which == g * reps + rep))
            # Put together the parcels hold the values in the order of their givers' seats.
            place = np.empty(len(seat), np.int64)
            place[np.argsort(_givers(seat, n, factor, shift))] = np.arange(len(seat))
            for p, i in enumerate(members[g]):
                columns.setdefault(i, []).append(parcels[f"p{p}"].combine_chunks().take(mine).flatten().take(pa.array(place)))
        kept = [c for c in takers.column_names if c.startswith("_k")]
        turn = pa.array(np.arange(len(seat) * reps).reshape(reps, len(seat)).T.ravel())
        offsets = pa.array((np.arange(len(seat) + 1) * reps).astype(np.int32))
        lists = {f"d{i}": pa.ListArray.from_arrays(offsets, pa.concat_arrays(columns[i]).take(turn)) for i in sorted(columns)}
        return pa.table({**{c: takers[c] for c in kept}, **lists})

    return run


def _dealt(df: DataFrame, key: str, groups: Mapping[str, Sequence[str]], fold: str, reps: int, keep: Sequence[str], seed: int) -> DataFrame:
    """Each row with an array of what it is dealt: (group, repetition, the group's features of another row of its fold).

    Rows are numbered once. A block of seats sends every other block one parcel per group and repetition, in which the values
    stand in the order of their givers' seats: where each goes follows from the move, so nothing but values is sent.
    """
    at = _group_index(groups)
    kind = _sent_type(df, list(at))
    hashed = df.withColumn("_h", key_hash(F.col(key), seed))
    seats = numbered(hashed, "_h", [key], [fold], "_seat", "_seats", bucket=hash_prefix(F.col("_h"), prefix_bits(df))).drop("_h")
    features = list(at)
    columns = list(dict.fromkeys([key, fold, *keep, *features]))
    rows = seats.select(
        F.col(fold).alias("_fold"), (F.col("_seat") - 1).cast("long").alias("_at"), F.col("_seats").cast("long").alias("_seats"),
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)],
    )
    block = BLOCK_SEATS
    marked = rows.withColumn("_block", F.floor(F.col("_at") / block).cast("long"))
    members = [[features.index(f) for f in group] for group in groups.values()]
    moves = seat_moves(len(groups), reps, seed)
    width = max(map(len, members))
    kind_of = df.schema[fold].dataType.simpleString()
    lists = ", ".join(f"p{i} array<{kind}>" for i in range(width))
    givers = marked.select("_fold", "_block", "_at", "_seats", *[F.col(f"_k{columns.index(f)}").cast(kind).alias(f"_v{i}") for i, f in enumerate(features)])
    parcels = givers.groupBy("_fold", "_block").applyInArrow(
        _deal(members, moves, block), f"_fold {kind_of}, _to long, g int, rep int, _first long, {lists}")
    schema = ", ".join([f"_k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(columns)] + [f"d{i} array<{kind}>" for i in range(len(features))])
    got = marked.groupBy("_fold", "_block").cogroup(parcels.groupBy("_fold", "_to")).applyInArrow(_take(members, moves, reps), schema)
    parts = [
        F.struct(F.lit(g).alias("g"), F.lit(rep).alias("rep"), F.array(*[F.col(f"d{i}")[rep] for i in members[g]]).alias("v")) for g, rep, _, _ in moves
    ]
    return got.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(columns)], F.array(*parts).alias("_dealt"))


def _shuffled(df: DataFrame, groups: Mapping[str, Sequence[str]], dealt: Column) -> dict[str, Column]:
    """Every feature: the dealt value where its group was dealt, else the row's own."""
    at = _group_index(groups)
    place = {f: list(members).index(f) for members in groups.values() for f in members}
    return {f: F.when(dealt["g"] == at[f], dealt["v"][place[f]].cast(df.schema[f].dataType)).otherwise(F.col(f)) for f in at}


def permuted_rows(df: DataFrame, key: str, groups: Mapping[str, Sequence[str]], fold: str, reps: int, keep: Sequence[str] = (),
                  seed: int = 42) -> DataFrame:
    """Copies of the table, one per (group, repetition), with the group's features shuffled within each fold.

    Features of a group move together. For scores of fitted models; column scores need no copies.
    """
    names = F.array(*[F.lit(name) for name in groups])
    rows = _dealt(df, key, groups, fold, reps, keep, seed).withColumn("_d", F.explode("_dealt"))
    return rows.select(
        key, fold, F.col("_d.rep").alias("rep"), F.element_at(names, F.col("_d.g") + 1).alias("feature_group"), *keep,
        *[c.alias(f) for f, c in _shuffled(df, groups, F.col("_d")).items()],
    )


def _scored_in_row(df: DataFrame, key: str, groups: Mapping[str, Sequence[str]], fold: str, reps: int, keep: Sequence[str], seed: int,
                   value: Callable[[Mapping[str, Column]], Column]) -> DataFrame:
    """(feature_group, rep, value) of every shuffled copy, computed next to the row it belongs to."""
    names = F.array(*[F.lit(name) for name in groups])
    rows = _dealt(df, key, groups, fold, reps, keep, seed).withColumn("_d", F.explode("_dealt"))
    return rows.select(F.element_at(names, F.col("_d.g") + 1).alias("feature_group"), "_d.rep", value(_shuffled(df, groups, F.col("_d"))).alias("x"))


def permutation_importance(df: DataFrame, key: str, groups: Mapping[str, Sequence[str]], score: ColumnScore | FrameScore, y: str, w: str,
                           fold: str, reps: int = 10, seed: int = 42, frame: bool = False) -> DataFrame:
    """Rise of the weighted squared error when a feature (or group) is shuffled, pooled over folds."""
    features = [f for members in groups.values() for f in members]

    def with_score(d: DataFrame) -> DataFrame:
        return score(d) if frame else d.withColumn("score", score({f: F.col(f) for f in features}))

    se = F.col(w) * (F.col(y) - F.col("score")) * (F.col(y) - F.col("score"))
    valid = df.where(F.col(w) > 0)
    base = with_score(valid).agg(F.sum(se).alias("sse"), F.sum(w).alias("sw")).first()
    sse, sw = F.lit(base["sse"]), F.lit(base["sw"])
    if frame:
        errors = with_score(permuted_rows(valid, key, groups, fold, reps, [y, w], seed)).select("feature_group", "rep", se.alias("x"))
    else:
        error = lambda x: F.col(w) * (F.col(y) - score(x)) * (F.col(y) - score(x))
        errors = _scored_in_row(valid, key, groups, fold, reps, [y, w], seed, error)
    runs = errors.groupBy("feature_group", "rep").agg(F.sum("x").alias("_sse"))
    delta = (F.col("_sse") - sse) / sw
    return runs.withColumn("_d", delta).groupBy("feature_group").agg(
        F.avg("_d").alias("delta_mse"), F.stddev_samp("_d").alias("delta_mse_sd")
    ).withColumn("increase_pct", F.col("delta_mse") / (sse / sw) * 100.0)
