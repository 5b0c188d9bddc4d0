"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import brown, crosspolytope, kneser, latent, mixing, secrets, simhash, tagpath, toxicity, wordpiece
from corvina.llm.common import fold_of, table

#: Folder of public vocabularies, read on the driver only.
TOKENIZERS = "/opt/tokenizers"

#: Target weights of the mixture; other sources have weight 1.
MIXTURE = {"src0": 3.0, "src1": 2.0, "src2": 0.5}


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), wordpiece.sentencepiece_vocabulary(vocabulary))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpath.extract_pages(table(spark, sf_dir, "pages"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents")).withColumn("spans", F.array_join("spans", ","))


def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"), MIXTURE)


OP10_SQL = f"""
WITH s AS (
  SELECT source, count(*) AS n, CASE source {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in MIXTURE.items())} ELSE 1.0::DOUBLE END AS w
  FROM documents GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS a, sum(w) AS ws FROM s),
r AS (SELECT source, a * 1.0::DOUBLE * w / ws / n AS rate FROM s, t),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12.0::DOUBLE * sqrt(rate) + 20)::INT + 1)) AS k FROM r WHERE rate > 0),
c AS (SELECT source, rate, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p FROM k),
l AS (SELECT source, rate, list(p ORDER BY p) AS cdf FROM c GROUP BY source, rate),
u AS (
  SELECT d.*, l.rate, l.cdf, (('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
n AS (SELECT * EXCLUDE (cdf, u), len(list_filter(cdf, lambda x: x < u))::INT AS n_copies FROM u),
e AS (SELECT *, unnest(range(1, n_copies + 1))::INT AS copy FROM n WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, copy, n_copies, rate,
  (('0x' || substr(md5('18:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(copy AS VARCHAR) || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS shuffle_key
FROM e
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_token_counts": op2_token_counts,
    "op8_html_extraction": op8_html_extraction,
    "op9_secret_scans": op9_secret_scans,
    "op10_poisson_mixing": op10_poisson_mixing,
}
ORACLE_SQL: dict[str, str] = {"op10_poisson_mixing": OP10_SQL}


def op5_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"), shingle=3, words=1, radius=3)


QUERIES["op5_simhash_classes"] = op5_simhash_classes


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 4) == 2
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.scorer(docs, model)(F.col("text")).alias("_t"))
    score = F.col("_t.score")
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= 0.3).cast("int").alias("predicted"), toxicity.offsets(F.col("_t.spans")).alias("spans"))


QUERIES["op4_toxicity"] = op4_toxicity


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_of("doc_id", 5) == 1
    scored = brown.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


QUERIES["op6_class_lm"] = op6_class_lm


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op7_kneser_ney_quality"] = op7_kneser_ney_quality


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES["op3_nearest_neighbours"] = op3_nearest_neighbours


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op1_decontamination"] = op1_decontamination
