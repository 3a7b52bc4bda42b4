"""Clusters and low-dimensional views of attribution vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.session import cut_lineage


def _scaled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(withMean=True, inputCol="_raw", outputCol="features")]
    return Pipeline(stages=stages).fit(df).transform(df).drop("_raw")


def attribution_clusters(phi: DataFrame, features: Sequence[str], k: int = 4, seed: int = 42) -> tuple[DataFrame, float]:
    """Cluster per row and the silhouette of the clustering."""
    data = _scaled(phi, features).persist()
    placed = KMeans(k=k, seed=seed, predictionCol="cluster").fit(data).transform(data)
    silhouette = ClusteringEvaluator(predictionCol="cluster").evaluate(placed)
    out = cut_lineage(placed.drop("features"))
    data.unpersist()
    return out, silhouette


def cluster_profile(placed: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean absolute and signed attribution of every feature in every cluster, and its rank there."""
    long = placed.unpivot([cluster], list(features), "feature", "phi")
    stats = long.groupBy(cluster, "feature").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.avg("phi").alias("mean_signed"), F.count("phi").alias("n"))
    top = stats.groupBy(cluster).agg(F.min(F.struct((-F.col("mean_abs")).alias("a"), "feature"))["feature"].alias("dominant_feature"))
    return stats.join(top, cluster)


def attribution_pca(phi: DataFrame, features: Sequence[str], n: int = 2) -> tuple[DataFrame, list[float]]:
    """First components per row and the variance each explains."""
    data = _scaled(phi, features)
    model = PCA(k=n, inputCol="features", outputCol="_pc").fit(data)
    scores = model.transform(data).withColumn("_a", vector_to_array("_pc"))
    out = scores.select(*phi.columns, *[F.col("_a")[i].alias(f"pc{i + 1}") for i in range(n)])
    return out, [float(x) for x in model.explainedVariance]
