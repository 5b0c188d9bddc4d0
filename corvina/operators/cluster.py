"""K-means with restarts, centroids' terms, and truncated singular value decomposition."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vectors(w: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, features: sparse vectors over a capped vocabulary (term, place from 0). At most the vocabulary's size per document."""
    size = terms.count()
    make = F.udf(lambda ps: SparseVector(size, sorted((p["place"], p["w"]) for p in ps)), VectorUDT())
    rows = w.join(F.broadcast(terms), "term").groupBy("doc_id").agg(F.collect_list(F.struct("place", "w")).alias("ps"))
    return rows.select("doc_id", make("ps").alias("features"))


def dense(v: Column) -> Column:
    return array_to_vector(v.cast("array<double>"))


def kmeans(rows: DataFrame, k: int, seed: int = 42, restarts: int = 10):
    """The model with the smallest cost over restarts; rows have features."""
    rows = rows.persist()
    try:
        models = [KMeans(k=k, seed=seed + i, maxIter=50).fit(rows) for i in range(restarts)]
        return min(models, key=lambda m: m.summary.trainingCost)
    finally:
        rows.unpersist()


def centroid_terms(spark, model, terms: list[str], k: int = 5) -> DataFrame:
    """cluster, rank, term, weight: the k heaviest terms of each centroid (ties by term)."""
    rows = []
    for c, centre in enumerate(model.clusterCenters()):
        order = sorted(range(len(terms)), key=lambda i: (-centre[i], terms[i]))[:k]
        rows += [(c, r, terms[i], float(centre[i])) for r, i in enumerate(order, 1)]
    return spark.createDataFrame(rows, "cluster int, rank int, term string, weight double")


def truncated_svd(rows: DataFrame, k: int = 2, id_col: str = "doc_id") -> DataFrame:
    """id, x1..xk: projection on the first k right singular vectors, uncentred.

    The sign of each is fixed so that its largest loading is positive. The
    matrix stays distributed; only the k right vectors are local.
    """
    matrix = IndexedRowMatrix(rows.select(id_col, "features").rdd.map(lambda r: IndexedRow(r[0], OldVectors.fromML(r[1]) if hasattr(OldVectors, "fromML") else r[1])))
    v = matrix.computeSVD(k, computeU=False).V.toArray()
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    project = F.udf(lambda x: [float(t) for t in (x.toArray() @ v)], "array<double>")
    out = rows.select(id_col, project("features").alias("p"))
    return out.select(id_col, *(F.col("p")[i].alias(f"x{i + 1}") for i in range(k)))


def members(assigned: DataFrame, per_cluster: int = 10, id_col: str = "doc_id") -> DataFrame:
    """prediction, rank, id: the first members of each cluster."""
    r = F.row_number().over(Window.partitionBy("prediction").orderBy(id_col))
    return assigned.withColumn("rank", r).where(F.col("rank") <= per_cluster).select("prediction", "rank", id_col)
