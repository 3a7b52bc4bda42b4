"""Boosted regression trees of several fits, grown side by side on rows of bins.

A tree gains one level in a pass over the table: a task finds the node and the residual of its rows under every fit and
leaves the sums of each (node, feature, bin). Sums are added by position, splits are chosen from them, and the next pass
takes the longer trees along, so a pass for many fits costs about as much as for one and no row is written back. Where the
rows of a fit are few, one task makes all its passes.

Losses, step sizes and guards are those of Spark's boosting: the first tree fits the labels (-1 and 1 for classes), further
ones the negative gradient; the finished trees are handed to Spark's own model classes.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts whose sums the driver adds itself; those of more parts are added in a shuffle.
FEW_PARTS = 32
#: Rows of a fit up to which one task grows all its trees.
FEW_CELLS = 200_000
#: Combinations of bins up to which an ensemble's predictions are tabulated.
TABLE_CELLS = 200_000


class Tree:
    """A binary tree in heap order from 1; a bin that is ``left`` of a node goes to its first child."""

    def __init__(self, depth: int, bins: int):
        size = 2 << depth
        self.feature = np.full(size, -1, np.int16)
        self.left = np.zeros((size, bins), bool)
        self.value, self.weight, self.impurity, self.gain = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size)
        self.levels = 0

    def nodes(self, b: np.ndarray) -> np.ndarray:
        """The node that every column of ``b`` (a row per feature) has reached."""
        node = np.ones(b.shape[1], np.int64)
        at = np.arange(b.shape[1])
        for _ in range(self.levels):
            f = self.feature[node]
            inner = f >= 0
            node = np.where(inner, 2 * node + ~self.left[node, b[np.maximum(f, 0), at]], node)
        return node


@dataclass(eq=False)
class Boost:
    """One ensemble of rows whose ``part`` is its own: of the fraction where present, or of the presence."""

    part: int
    fraction: bool
    n_trees: int
    step: float
    min_share: float
    max_depth: int
    subsample: float
    seed: int
    sizes: tuple[int, ...]
    nominal: tuple[int, ...] = ()
    trees: list[Tree] = field(default_factory=list)
    table: np.ndarray | None = None

    def margin(self, b: np.ndarray, trees: Sequence[Tree] | None = None) -> np.ndarray:
        out = np.zeros(b.shape[1])
        for i, tree in enumerate(self.trees if trees is None else trees):
            out += (self.step if i else 1.0) * tree.value[tree.nodes(b)]
        return out

    def predict(self, b: np.ndarray) -> np.ndarray:
        """The probability of presence, or the fraction, not clipped."""
        if self.table is not None:
            return self.table[np.ravel_multi_index(tuple(b), self.sizes)]
        return self.margin(b) if self.fraction else 1 / (1 + np.exp(-2 * self.margin(b)))

    def importances(self) -> np.ndarray:
        """Each feature's share of the gain of all trees."""
        out = np.zeros(len(self.sizes))
        for tree in self.trees:
            inner = tree.feature >= 0
            out += np.bincount(tree.feature[inner], tree.gain[inner] * tree.weight[inner], len(out))
        return out / out.sum() if out.sum() > 0 else out

    def finish(self) -> None:
        """Tabulate the predictions of all combinations of bins, where they are few."""
        if math.prod(self.sizes) <= TABLE_CELLS:
            self.table = self.predict(np.indices(self.sizes).reshape(len(self.sizes), -1))

    def residual(self, label: np.ndarray, fraction: np.ndarray, b: np.ndarray) -> np.ndarray:
        done = self.trees[:-1]  # the last one is being grown
        if self.fraction:
            return 2 * (fraction - self.margin(b, done)) if done else fraction
        sign = 2 * label - 1
        return 4 * sign / (1 + np.exp(2 * sign * self.margin(b, done))) if done else sign

    def drawn(self, b: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The rows that the tree being grown is fitted on; a draw depends on the row's bins and nothing else."""
        if self.subsample >= 1:
            return np.ones(b.shape[1], bool)
        z = np.full(b.shape[1], (self.seed * 1_000_003 + len(self.trees)) & 0xFFFFFFFF, np.uint64) + label.astype(np.uint64)
        for row in b:
            z = (z + row.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
        return (z >> np.uint64(11)).astype(float) * 2.0**-53 < self.subsample


def _shape(fits: Sequence[Boost], level: int) -> tuple[int, int, int]:
    return 1 << level, len(fits[0].sizes), max(max(f.sizes) for f in fits)


def _sums(fits: Sequence[Boost], level: int, part, label, weight, fraction, b: np.ndarray) -> np.ndarray:
    """Per fit: weights and weighted residuals of every (node, feature, bin), weighted squares of every node."""
    nodes, width, bins = _shape(fits, level)
    cube = nodes * width * bins
    sums = np.zeros((len(fits), 2 * cube + nodes))
    for i, f in enumerate(fits):
        own = np.flatnonzero((part == f.part) & (weight > 0) & ((label == 1) | (not f.fraction)))
        own = own[f.drawn(b[:, own], label[own])]
        node = f.trees[-1].nodes(b[:, own]) - nodes
        own, node = own[node >= 0], node[node >= 0]
        if not len(own):
            continue
        mine, w = b[:, own], weight[own]
        r = f.residual(label[own], fraction[own], mine)
        for j in range(width):
            at = (node * width + j) * bins + mine[j]
            sums[i, :cube] += np.bincount(at, w, cube)
            sums[i, cube:2 * cube] += np.bincount(at, w * r, cube)
        sums[i, 2 * cube:] += np.bincount(node, w * r * r, nodes)
    return sums


def _columns(table: pa.RecordBatch | pa.Table) -> tuple:
    part, label, weight, fraction, *bs = (c.to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else c.to_numpy() for c in table.columns)
    return part, label, weight, fraction, np.vstack(bs).astype(np.int64)


def _level_sums(fits: Sequence[Boost], level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = sum(_sums(fits, level, *_columns(batch)) for batch in batches)
        flat = np.ravel(sums)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_pydict({"i": at.astype(np.int64), "v": flat[at]})

    return run


def _grown_here(fits: Sequence[Boost], totals: Sequence[float]):
    """All trees of the fit whose rows these are."""

    def run(table: pa.Table) -> pa.Table:
        i = table["fit"][0].as_py()
        columns = _columns(table.drop_columns(["fit"]))
        _boost([fits[i]], [totals[i]], lambda live, level: _sums(live, level, *columns))
        return pa.table({"fit": pa.array([i], pa.int32()), "trees": [pickle.dumps(fits[i].trees)]})

    return run


def added(df: DataFrame, run, size: int, parts: int) -> np.ndarray:
    """The sums that the tasks of ``run``, as many as there are ``parts``, leave by position."""
    found = df.mapInArrow(run, "i long, v double")
    if parts > FEW_PARTS:
        found = found.groupBy("i").agg(F.sum("v").alias("v"))
    table = found.toArrow()
    return np.bincount(table["i"].to_numpy(), table["v"].to_numpy(), size)


def _best_split(f: Boost, w: np.ndarray, s: np.ndarray, floor: float) -> tuple[float, int, np.ndarray, tuple] | None:
    """Gain, feature, left bins and the sums of both sides: the split of a node that lowers the variance most."""
    total, whole = w[0].sum(), s[0].sum()
    best = None
    for j, size in enumerate(f.sizes):
        wj, sj = w[j, :size], s[j, :size]
        order = np.arange(size)
        if j in f.nominal:
            # Categories in the order of their means; those without rows come last.
            order = np.argsort(np.where(wj > 0, sj / np.where(wj > 0, wj, 1), np.inf), kind="stable")
        wl, sl = np.cumsum(wj[order])[:-1], np.cumsum(sj[order])[:-1]
        wr, sr = total - wl, whole - sl
        fits = (np.cumsum(wj[order] > 0)[:-1] > 0) & (np.cumsum((wj[order] > 0)[::-1])[::-1][1:] > 0) & (wl >= floor) & (wr >= floor)
        if not fits.any():
            continue
        gain = np.full(len(wl), -np.inf)
        gain[fits] = (sl[fits] ** 2 / wl[fits] + sr[fits] ** 2 / wr[fits] - whole**2 / total) / total
        at = int(np.argmax(gain))
        if best is None or gain[at] > best[0]:
            left = np.zeros(w.shape[1], bool)
            left[order[:at + 1]] = True
            best = gain[at], j, left, (wl[at], sl[at], wr[at], sr[at])
    return best


def _extend(f: Boost, sums: np.ndarray, level: int, shape: tuple[int, int, int], total: float) -> bool:
    """One more level of the last tree; False where no node was split."""
    nodes, width, bins = shape
    cube = nodes * width * bins
    w, s = sums[:cube].reshape(shape), sums[cube:2 * cube].reshape(shape)
    squares, tree, grew = sums[2 * cube:], f.trees[-1], False
    for i in range(nodes):
        own, whole = w[i, 0].sum(), s[i, 0].sum()
        if own <= 0:
            continue
        node = nodes + i
        tree.weight[node], tree.value[node] = own, whole / own
        tree.impurity[node] = max(squares[i] / own - (whole / own) ** 2, 0.0)
        best = _best_split(f, w[i], s[i], f.min_share * total)
        if best is None or best[0] <= 1e-12 * max(tree.impurity[node], (whole / own) ** 2 * 1e-6, 1e-30):
            continue
        tree.gain[node], tree.feature[node], left, (wl, sl, wr, sr) = best
        tree.left[node, :len(left)] = left
        tree.weight[2 * node:2 * node + 2] = wl, wr
        tree.value[2 * node:2 * node + 2] = sl / wl, sr / wr
        grew = True
    tree.levels = level + 1
    return grew


def _boost(fits: Sequence[Boost], totals: Sequence[float], sums_of: Callable[[Sequence[Boost], int], np.ndarray]) -> None:
    total = {id(f): w for f, w in zip(fits, totals, strict=True)}
    for turn in range(max(f.n_trees for f in fits)):
        growing = [f for f in fits if turn < f.n_trees]
        for f in growing:
            f.trees.append(Tree(f.max_depth, max(f.sizes)))
        live = growing
        for level in range(max(f.max_depth for f in growing)):
            live = [f for f in live if level < f.max_depth]
            if not live:
                break
            shape = _shape(live, level)
            live = [f for f, own in zip(live, sums_of(live, level), strict=True) if _extend(f, own, level, shape, total[id(f)])]


def grow(cells: DataFrame, bins: Sequence[str], fits: Sequence[Boost], few_cells: int = FEW_CELLS) -> None:
    """Grow all trees of ``fits``. ``cells`` holds ``part``, ``_label``, ``_weight``, ``_fraction`` and the bins.

    Where no part has more than ``few_cells`` rows, each fit is one task's work, all in one job; else a pass over all parts adds
    a level to the trees of all fits.
    """
    base = cells.select(
        F.col("part").cast("int").alias("part"), F.col("_label").cast("double").alias("_label"), F.col("_weight").cast("double").alias("_weight"),
        F.coalesce(F.col("_fraction").cast("double"), F.lit(0.0)).alias("_fraction"), *[F.col(b).cast("int").alias(b) for b in bins],
    )
    known = cells.groupBy("part", "_label").agg(F.count(F.lit(1)).alias("n"), F.sum("_weight").alias("w")).collect()
    totals = [sum(r["w"] for r in known if r["part"] == f.part and (r["_label"] == 1 or not f.fraction)) for f in fits]
    if max(sum(r["n"] for r in known if r["part"] == f.part) for f in fits) <= few_cells:
        own = [F.struct(F.lit(i).alias("fit"), F.lit(f.part).alias("of"), F.lit(f.fraction).alias("f")) for i, f in enumerate(fits)]
        dealt = base.withColumn("_to", F.explode(F.array(*own))).where("_to.of = part AND (_label = 1 OR NOT _to.f)").select(F.col("_to.fit").alias("fit"), *base.columns)
        grown = dealt.repartition(2 * len(fits), "fit").groupBy("fit").applyInArrow(_grown_here(fits, totals), "fit int, trees binary")
        for row in grown.collect():
            fits[row["fit"]].trees = pickle.loads(row["trees"])
    else:
        parts = base.rdd.getNumPartitions()

        def sums_of(live: Sequence[Boost], level: int) -> np.ndarray:
            size = 2 * math.prod(_shape(live, level)) + _shape(live, level)[0]
            return added(base, _level_sums(live, level), size * len(live), parts).reshape(len(live), size)

        _boost(fits, totals, sums_of)
    for f in fits:
        f.finish()


# --- the same trees as Spark's models ----------------------------------------------------------


def _node(jvm, gateway, f: Boost, tree: Tree, node: int):
    stats = gateway.new_array(jvm.double, 3)
    w, mean = float(tree.weight[node]), float(tree.value[node])
    impurity = float(tree.impurity[node])
    for i, x in enumerate((w, w * mean, w * (impurity + mean * mean))):
        stats[i] = x
    calculator = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(stats, max(round(w), 1))
    j = int(tree.feature[node])
    if j < 0:
        return jvm.org.apache.spark.ml.tree.LeafNode(mean, impurity, calculator)
    left = np.flatnonzero(tree.left[node])
    if j in f.nominal:
        chosen = gateway.new_array(jvm.double, len(left))
        for i, x in enumerate(left):
            chosen[i] = float(x)
        split = jvm.org.apache.spark.ml.tree.CategoricalSplit(j, chosen, f.sizes[j])
    else:
        split = jvm.org.apache.spark.ml.tree.ContinuousSplit(j, float(left.max()) + 0.5)
    first, second = (_node(jvm, gateway, f, tree, 2 * node + side) for side in (0, 1))
    return jvm.org.apache.spark.ml.tree.InternalNode(mean, impurity, float(tree.gain[node]), first, second, split, calculator)


def as_model(spark, f: Boost, features: str) -> GBTClassificationModel | GBTRegressionModel:
    """The ensemble as Spark's model over a vector of bins in the column ``features``."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees = gateway.new_array(kind, len(f.trees))
    weights = gateway.new_array(jvm.double, len(f.trees))
    name = lambda prefix: jvm.org.apache.spark.ml.util.Identifiable.randomUID(prefix)
    for i, tree in enumerate(f.trees):
        trees[i] = kind(name("dtr"), _node(jvm, gateway, f, tree, 1), len(f.sizes))
        weights[i] = f.step if i else 1.0
    if f.fraction:
        model = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(name("gbtr"), trees, weights, len(f.sizes)))
    else:
        model = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(name("gbtc"), trees, weights, len(f.sizes), 2))
    return model.setFeaturesCol(features)
