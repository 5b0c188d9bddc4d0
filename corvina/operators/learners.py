"""Documented learners: MLlib models, nearest neighbours, and semi-supervised loops."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one block of a nearest-neighbour search.
BLOCK = 8_192

MODELS = {
    "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=20)),
    "logistic": lambda: LogisticRegression(maxIter=50),
    "forest": lambda: RandomForestClassifier(numTrees=30, seed=42),
    "gaussian_nb": lambda: NaiveBayes(modelType="gaussian"),
}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    A session on one machine that names none gets a temporary one; elsewhere
    that is an error, as executors would not see it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvina-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut in the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fit_predict(name: str, train: DataFrame, rows: DataFrame, vector_col: str = "embedding", label_col: str = "label", id_col: str = "vec_id") -> DataFrame:
    """id, predicted by one of MODELS."""
    vector = array_to_vector(F.col(vector_col).cast("array<double>")).alias("features")
    model = MODELS[name]().fit(train.select(vector, F.col(label_col).cast("double").alias("label")))
    return model.transform(rows.select(F.col(id_col), vector)).select(id_col, F.col("prediction").cast("int").alias("predicted"))


def neighbours(rows: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "cosine") -> DataFrame:
    """query_id, rank, vec_id, score: the exact k nearest of each query, blocks of queries against blocks of rows.

    Every block of rows passes on k of its rows for each query, so what is
    shuffled is k * blocks for a query. ``metric``: cosine, or euclidean (then
    score is minus the distance).
    """
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    n = v.agg(F.count(F.lit(1)), F.count_if("q")).first()
    row_blocks, query_blocks = max(1, -(-n[0] // BLOCK)), max(1, -(-n[1] // BLOCK))
    place = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    data = v.select(place(row_blocks).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "id", "v")
    asks = v.where("q").select(F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), place(query_blocks).alias("qb"), "id", "v")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, y = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        if metric == "cosine":
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
            s = y @ x.T
        else:
            s = -np.sqrt(np.maximum((y**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * y @ x.T, 0))
        s[right["id"].to_numpy()[:, None] == left["id"].to_numpy()[None]] = -np.inf
        # equal scores by id: ids in order, and a stable sort
        order = np.argsort(left["id"].to_numpy(), kind="stable")
        s, ids = np.round(s[:, order], 12), left["id"].to_numpy()[order]
        m = min(k, len(ids))
        at = np.argsort(-s, axis=1, kind="stable")[:, :m]
        out = pd.DataFrame({"query_id": np.repeat(right["id"].to_numpy(), m), "vec_id": ids[at].ravel(), "score": np.take_along_axis(s, at, 1).ravel()})
        return out[np.isfinite(out["score"])]

    found = data.groupBy("rb", "qb").cogroup(asks.groupBy("rb", "qb")).applyInPandas(best, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def vote(near: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, predicted: the most frequent label among the neighbours (ties: the smallest). labels: vec_id, label."""
    n = near.join(labels, "vec_id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "label"))
    return n.withColumn("r", best).where("r = 1").select("query_id", F.col("label").alias("predicted"))


def recommend(near: DataFrame, ratings: DataFrame, n: int) -> DataFrame:
    """query_id, rank, item, score: what neighbours rated and the query did not, by the mean rating weighted by nearness.

    near: query_id, vec_id, score; ratings: vec_id, item, rating, one row for a
    pair. Neighbours of no positive nearness have no say; ties go to the
    smaller item.
    """
    said = near.where("score > 0").join(ratings, "vec_id").groupBy("query_id", "item").agg((F.sum(F.col("score") * F.col("rating")) / F.sum("score")).alias("score"))
    new = said.join(ratings.select(F.col("vec_id").alias("query_id"), "item"), ["query_id", "item"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "item"))
    return new.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "rank", "item", "score")


def self_training(labelled: DataFrame, unlabelled: DataFrame, predict, threshold: float = 0.95, rounds: int = 3) -> DataFrame:
    """doc_id, label, round: predictions of at least ``threshold`` join the training labels, round by round.

    ``predict(labels, docs)`` gives doc_id, label, p; labels and docs hold doc_id (and label).
    """
    known = checkpointed(labelled.select("doc_id", "label", F.lit(0).alias("round")))
    rest = checkpointed(unlabelled.select("doc_id"))
    for k in range(1, rounds + 1):
        sure = checkpointed(predict(known, rest).where(F.col("p") >= threshold).select("doc_id", "label", F.lit(k).alias("round")))
        if not sure.limit(1).count():
            break
        known = checkpointed(known.unionByName(sure))
        rest = checkpointed(rest.join(sure, "doc_id", "left_anti"))
    return known


def co_training(labelled: DataFrame, unlabelled: DataFrame, views: tuple, threshold: float = 0.95, rounds: int = 2) -> DataFrame:
    """doc_id, label, round: two predictors on two views teach each other with what they are sure of and don't contradict."""
    known = checkpointed(labelled.select("doc_id", "label", F.lit(0).alias("round")))
    rest = checkpointed(unlabelled.select("doc_id"))
    for k in range(1, rounds + 1):
        sure = [v(known, rest).where(F.col("p") >= threshold).select("doc_id", "label") for v in views]
        both = sure[0].unionByName(sure[1]).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
        new = checkpointed(both.select("doc_id", "label", F.lit(k).alias("round")))
        if not new.limit(1).count():
            break
        known = checkpointed(known.unionByName(new))
        rest = checkpointed(rest.join(new, "doc_id", "left_anti"))
    return known


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 10, alpha: float | None = None) -> DataFrame:
    """node, label, p: labels spread over weighted edges (a, b, w), both ways.

    Without ``alpha`` seeds keep their labels (propagation); with it their own
    label has weight 1 - alpha and edges are normalised by degree (spreading).
    """
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    both = both.groupBy("a", "b").agg(F.max("w").alias("w"))
    degree = both.groupBy("a").agg(F.sum("w").alias("d"))
    if alpha is None:
        walk = both.join(degree, "a").select("a", "b", (F.col("w") / F.col("d")).alias("w"))
    else:
        walk = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))
    walk = checkpointed(walk)
    own = seeds.select(F.col("node"), "label", F.lit(1.0).alias("p"))
    now = checkpointed(own)
    for _ in range(rounds):
        moved = walk.join(now, walk["b"] == now["node"]).groupBy(F.col("a").alias("node"), "label").agg(F.sum(F.col("w") * F.col("p")).alias("p"))
        if alpha is None:
            total = F.sum("p").over(Window.partitionBy("node"))
            moved = moved.join(seeds.select("node"), "node", "left_anti").withColumn("p", F.col("p") / total).unionByName(own)
        else:
            moved = moved.withColumn("p", F.col("p") * alpha).unionByName(own.withColumn("p", F.col("p") * (1 - alpha))).groupBy("node", "label").agg(F.sum("p").alias("p"))
        now = checkpointed(moved)
    return now


def best_label(p: DataFrame) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("node").orderBy(F.desc(F.round("p", 12)), "label"))
    return p.withColumn("r", r).where("r = 1").select("node", "label")

