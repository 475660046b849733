"""Columns grouped by what their profiles look like."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def kmeans_columns(profiled: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """(colname, cluster): k-means on entropy and cardinality; k is half the number of columns unless given."""
    rows = profiled.select("colname", "position", F.coalesce("entropy", F.lit(0.0)).alias("entropy"), F.coalesce("cardinality", F.lit(0.0)).alias("cardinality"))
    n = rows.count()
    k = min(n, max(2, k or n // 2))
    if n < 2:
        return rows.select("colname", F.lit(0).alias("cluster"))
    points = VectorAssembler(inputCols=["entropy", "cardinality"], outputCol="features").transform(rows.orderBy("position"))
    model = KMeans(k=k, seed=seed).fit(points)
    return model.transform(points).select("colname", F.col("prediction").alias("cluster"))


def cluster_columns(profiled: DataFrame, seed: int = 42) -> list[list[str]]:
    out: dict[int, list[str]] = {}
    for r in kmeans_columns(profiled, seed=seed).collect():
        out.setdefault(r["cluster"], []).append(r["colname"])
    return [out[k] for k in sorted(out)]


def first_of_clusters(clustered: DataFrame, items: int) -> DataFrame:
    """At most ``items`` columns of each cluster."""
    n = F.row_number().over(Window.partitionBy("cluster").orderBy("colname"))
    return clustered.withColumn("n", n).where(F.col("n") <= items).drop("n")
