"""Crop-share models: softmax composition with linear or tree scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.models.design import linear, logistic, vectorized
from gridspark.models.two_stage import PART_CELLS
from gridspark.operators.crops import with_group_totals

SHARE_EPS = 1e-6


def stable_softmax(long: DataFrame, score: str, by: Sequence[str], name: str = "p") -> DataFrame:
    """Shares per group from scores, shifted by the maximum and clipped to +-50."""
    shifted = with_group_totals(long, by, _top=F.max(score)).withColumn(
        "_e", F.exp(F.least(F.greatest(F.col(score) - F.col("_top"), F.lit(-50.0)), F.lit(50.0)))
    )
    return with_group_totals(shifted, by, _sum=F.sum("_e")).withColumn(name, F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")


@dataclass(frozen=True)
class FractionalLogit:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def mean(self) -> Column:
        return logistic(linear(self.features, self.coefficients, self.intercept))


def fraction_rows(df: DataFrame, y: str, eps: float = 1e-6) -> DataFrame:
    """Each fraction as a success and a failure row that share its weight.

    The weighted logistic likelihood of these rows is the fractional-logit
    quasi-likelihood, so MLlib's solver fits it exactly.
    """
    share = F.least(F.greatest(F.col(y), F.lit(eps)), F.lit(1.0 - eps))
    halves = F.array(F.struct(F.lit(1.0).alias("label"), share.alias("share")), F.struct(F.lit(0.0).alias("label"), (F.lit(1.0) - share).alias("share")))
    return df.withColumn("_half", F.explode(halves)).select("*", "_half.label", "_half.share").drop("_half")


def fit_fractional_logit(rows: DataFrame, features: Sequence[str], weight: Column, l2: float = 1e-4, max_iter: int = 80) -> FractionalLogit:
    """Fit on the output of :func:`fraction_rows` that also holds a ``features`` vector."""
    weighted = rows.withColumn("_w", F.col("share") * weight)
    model = LogisticRegression(weightCol="_w", regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-8).fit(weighted)
    return FractionalLogit(tuple(features), tuple(float(b) for b in model.coefficients), float(model.intercept))


def fractional_logit(df: DataFrame, y: str, features: Sequence[str], w: str | None = None, l2: float = 1e-4) -> FractionalLogit:
    data, _ = vectorized(df, features)
    rows = fraction_rows(data, y).persist()
    model = fit_fractional_logit(rows, features, F.lit(1.0) if w is None else F.col(w), l2)
    rows.unpersist()
    return model


# --- linear softmax with one coefficient shared by all crops ---------------------------------


@dataclass(frozen=True)
class SoftmaxShare:
    """``beta[k]`` = intercept and coefficients of crop k (zero for the reference crop)."""

    crops: tuple[str, ...]
    features: tuple[str, ...]
    shared: str
    beta: np.ndarray
    shared_beta: float
    loss: float

    def score(self) -> Column:
        out = F.lit(0.0)
        for k, crop in enumerate(self.crops):
            eta = linear(self.features, self.beta[k, 1:], self.beta[k, 0])
            out = F.when(F.col("crop") == crop, eta).otherwise(out)
        return out + F.lit(self.shared_beta) * F.col(self.shared)


def _partial_gradients(crops: Sequence[str], reference: int, n_features: int, beta: np.ndarray, gamma: float):
    """Loss and gradient sums of a batch of cells; one row per task leaves the executors."""
    size = beta.size + 3

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), np.vstack(batch["x"].to_numpy())])
            z, y = np.vstack(batch["z"].to_numpy()), np.vstack(batch["y"].to_numpy())
            w = batch["w"].to_numpy()[:, None]
            eta = x @ beta.T + gamma * z
            eta = np.clip(eta - eta.max(axis=1, keepdims=True), -50, 50)
            p = np.exp(eta)
            p /= p.sum(axis=1, keepdims=True)
            residual = w * (p * y.sum(axis=1, keepdims=True) - y)
            gradient = residual.T @ x
            gradient[reference] = 0.0
            total[: beta.size] += gradient.ravel()
            total[beta.size] += (residual * z).sum()
            total[beta.size + 1] += -(w * y * np.log(np.clip(p, 1e-12, 1))).sum()
            total[beta.size + 2] += w.sum()
        yield pd.DataFrame({"i": np.arange(size), "v": total})

    return run


def _lbfgs(objective, theta: np.ndarray, max_iter: int, tol: float, memory: int = 8) -> tuple[np.ndarray, float]:
    """Limited-memory quasi-Newton steps with halving line search, over coefficients only."""
    loss, grad = objective(theta)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        q, alphas = grad.copy(), []
        for s, t in reversed(history):
            a = (s @ q) / (t @ s)
            alphas.append(a)
            q -= a * t
        if history:
            s, t = history[-1]
            q *= (s @ t) / (t @ t)
        for (s, t), a in zip(history, reversed(alphas), strict=True):
            q += (a - (t @ q) / (t @ s)) * s
        step, slope = 1.0, -(grad @ q)
        if not history:
            step = min(1.0, 1.0 / max(np.abs(grad).max(), 1e-12))
        while True:
            candidate = theta - step * q
            new_loss, new_grad = objective(candidate)
            if new_loss <= loss + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, t = candidate - theta, new_grad - grad
        if s @ t > 1e-12:
            history = [*history[-(memory - 1):], (s, t)]
        done = abs(loss - new_loss) <= tol * max(1.0, abs(loss))
        theta, loss, grad = candidate, new_loss, new_grad
        if done:
            break
    return theta, loss


def softmax_share_linear(long: DataFrame, crops: Sequence[str], features: Sequence[str], shared: str, reference: str, y: str = "y",
                         w: str = "w", cell: Sequence[str] = ("r", "c"), l2: float = 0.02, max_iter: int = 100, tol: float = 1e-8) -> SoftmaxShare:
    """Fractional multinomial logit: crop-specific coefficients plus one on a crop-varying input.

    Cells are packed to one row with one slot per crop; each objective call is
    one pass that returns a vector as long as the parameters.
    """
    slot = lambda c: F.array(*[F.coalesce(F.max(F.when(F.col("crop") == k, F.col(c))), F.lit(0.0)) for k in crops])
    packed = long.groupBy(*cell).agg(
        F.array(*[F.max(f) for f in features]).alias("x"), slot(shared).alias("z"), slot(y).alias("y"), F.max(w).alias("w")
    ).select("x", "z", "y", "w").persist()
    k, p, ref = len(crops), len(features), list(crops).index(reference)
    shape = (k, p + 1)

    def objective(theta: np.ndarray) -> tuple[float, np.ndarray]:
        beta, gamma = theta[:-1].reshape(shape), float(theta[-1])
        parts = packed.mapInPandas(_partial_gradients(crops, ref, p, beta, gamma), "i int, v double")
        sums = np.zeros(beta.size + 3)
        for row in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
            sums[row["i"]] = row["v"]
        n = sums[-1]
        loss = sums[-2] / n + 0.5 * l2 * (np.sum(beta[:, 1:] ** 2) + gamma**2)
        grad = sums[: beta.size].reshape(shape) / n
        grad[:, 1:] += l2 * beta[:, 1:]
        return float(loss), np.append(grad.ravel(), sums[beta.size] / n + l2 * gamma)

    theta, loss = _lbfgs(objective, np.zeros(k * (p + 1) + 1), max_iter, tol)
    packed.unpersist()
    return SoftmaxShare(tuple(crops), tuple(features), shared, theta[:-1].reshape(shape), float(theta[-1]), loss)


def softmax_share_tree(train: DataFrame, test: DataFrame, numeric: Sequence[str], categorical: Sequence[str], y: str = "y", w: str = "w",
                       cell: Sequence[str] = ("r", "c"), trees: int = 100, max_depth: int = 5, seed: int = 42) -> DataFrame:
    """Boosted trees on the log share of long rows; scores of a cell become shares by softmax."""
    both = train.withColumn("_train", F.lit(True)).unionByName(test.withColumn("_train", F.lit(False)))
    data, _ = vectorized(both.withColumn("_t", F.log(F.col(y) + F.lit(SHARE_EPS))), numeric, categorical)
    rows = data.where("_train").select("features", "_t", w).persist()
    # Boosting is a chain of jobs, each over all parts, so there are as many as the rows need.
    parts = rows.coalesce(1 + rows.count() // PART_CELLS).persist()
    model = GBTRegressor(labelCol="_t", weightCol=w, maxIter=trees, maxDepth=max_depth, subsamplingRate=0.85, maxBins=64, seed=seed).fit(parts)
    parts.unpersist()
    rows.unpersist()
    scored = model.transform(data.where("NOT _train")).drop("features", "_t", "_train")
    return stable_softmax(scored, "prediction", cell).drop("prediction", *[f"_ix_{c}" for c in categorical])
