"""Clusters of vectors: how many, and which row belongs to which."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clustered(df: DataFrame, vector: str, k: int, seeds: Iterable[int] = (42, 43, 44)) -> DataFrame:
    """``cluster`` of each row: the cheapest of k-means runs with several seeds."""
    rows = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    vectors = rows.select("__v").cache()
    models = [KMeans(k=k, seed=s, featuresCol="__v", predictionCol="cluster").fit(vectors) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    vectors.unpersist()
    return best.transform(rows).drop("__v")


def choose_k(df: DataFrame, id_: str, vector: str, ks: Iterable[int] = range(3, 13), seed: int = 42) -> DataFrame:
    """k, silhouette, best: the number of clusters with the highest silhouette, the lowest of equals."""
    spark = df.sparkSession
    rows = df.select(id_, array_to_vector(F.col(vector).cast("array<double>")).alias("features")).cache()
    n = rows.count()
    ks = [k for k in ks if k <= n - 1] or [max(2, min(3, n - 1))]
    score = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    got = [(k, float(score.evaluate(KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows).transform(rows)))) for k in ks]
    best = max(got, key=lambda x: (x[1], -x[0]))[0]
    rows.unpersist()
    return spark.createDataFrame([(k, s, k == best) for k, s in got], "k int, silhouette double, best boolean")
