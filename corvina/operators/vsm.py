"""Vector-space model: term frequencies, inverse document frequencies, weights, ranking, cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import text as tx


def term_counts(docs: DataFrame, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, term, tf. Repeats within a document are summed before the shuffle."""
    tokens = tx.vector_tokens(F.col(text_col)) if tokens is None else tokens
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def idf(counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """term, df, idf = ln((1 + n) / (1 + df)) + 1; ``n_docs`` is one row with n."""
    # the sum keeps tf in this branch: the counts are then one exchange, made once for all that reads them
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n_term")).where("n_term > 0").drop("n_term")
    return df.join(F.broadcast(n_docs)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def number(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n"))


def weights(counts: DataFrame, idfs: DataFrame) -> DataFrame:
    """doc_id, term, w: tf * idf, of length 1 per document."""
    raw = counts.join(idfs, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("raw") / norm).alias("w"))


def tfidf(docs: DataFrame, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_features: int | None = None) -> DataFrame:
    counts = term_counts(docs, tokens, id_col, text_col)
    if max_features:
        counts = counts.join(F.broadcast(cap(counts, max_features).select("term")), "term")
    return weights(counts, idf(counts, number(docs)))


def cap(counts: DataFrame, k: int) -> DataFrame:
    """The k terms with the most occurrences (ties by term): term, n."""
    return counts.groupBy("term").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def scores(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: cosine of each document and the query, with the corpus' own frequencies; 0 for no common term.

    One aggregation by document gives its length and its product with the
    query; the query's own length is one row.
    """
    spark = docs.sparkSession
    counts = term_counts(docs, None, id_col, text_col)
    idfs = idf(counts, number(docs))
    q = spark.createDataFrame([(query,)], "text string").select(F.explode(tx.vector_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf_q"))
    # the query's terms are as many as its words
    q = F.broadcast(q)
    length = idfs.join(q, "term").agg(F.sqrt(F.sum(F.pow(F.col("tf_q") * F.col("idf"), F.lit(2.0)))).alias("length_q"))
    raw = F.col("tf") * F.col("idf")
    found = counts.join(idfs, "term").join(q, "term", "left").groupBy("doc_id").agg(F.sqrt(F.sum(raw * raw)).alias("length"), F.sum(raw * F.col("tf_q") * F.col("idf")).alias("product"))
    found = found.where("product is not null").join(F.broadcast(length)).select("doc_id", (F.col("product") / F.col("length") / F.col("length_q")).alias("s"))
    return docs.select(F.col(id_col).alias("doc_id")).join(found, "doc_id", "left").select("doc_id", F.coalesce("s", F.lit(0.0)).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best with their rank; ties by id. Scores are compared as rounded to 9 places, so that equal ones tie."""
    best = scored.withColumn("_r", F.round("score", 9)).orderBy(F.desc("_r"), "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_r"), "doc_id"))).drop("_r")


def cosine_pairs(w: DataFrame) -> DataFrame:
    """doc_a < doc_b, sim for all pairs with a common term: for few documents, such as one for each source."""
    a, b = w.select(F.col("doc_id").alias("doc_a"), "term", F.col("w").alias("wa")), w.select(F.col("doc_id").alias("doc_b"), "term", F.col("w").alias("wb"))
    return a.join(b, "term").where("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))


def cosine_matrix(w: DataFrame) -> DataFrame:
    """doc_a, doc_b, sim of the dense matrix: diagonal 1, symmetric, 0 without a common term. n * n rows, for small corpora."""
    ids = w.select("doc_id").distinct()
    grid = ids.select(F.col("doc_id").alias("doc_a")).join(ids.select(F.col("doc_id").alias("doc_b")))
    p = cosine_pairs(w)
    both = p.unionByName(p.select(F.col("doc_b").alias("doc_a"), F.col("doc_a").alias("doc_b"), "sim"))
    return grid.join(both, ["doc_a", "doc_b"], "left").select("doc_a", "doc_b", F.when(F.col("doc_a") == F.col("doc_b"), 1.0).otherwise(F.coalesce("sim", F.lit(0.0))).alias("sim"))
