"""From raw documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``. Every row is judged by itself, whether
its id is null or repeats; rows with null texts go through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import latent, mixing, neardup, secrets, toxicity
from corvina.llm.common import cut, private, shared_folder, table
from corvina.llm.queries import MIXTURE

#: Documents from this score on are rejected as toxic, as op4_toxicity predicts.
TOXIC_AT = 0.3

#: Near-duplicates: a Jaccard similarity of 0.8 or more of their 5-word shingles.
SHINGLE, SIMILARITY = 5, 0.8

_KEY = "_pipeline_row_key"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_AT; one pass over the texts."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.column(docs, model, F.col("text")) < TOXIC_AT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the smallest id (null ids last), once if it repeats."""
    found = cut(neardup.classes(docs, SIMILARITY, SHINGLE))
    own = private(docs, _KEY)
    keyed = docs.withColumn(own, neardup.row_key("doc_id", "text"))
    others = found.where("not stays").select(F.col("row_key").alias(own)).distinct()
    left = keyed.join(others, own, "left_anti")
    again = cut(found.where("stays").groupBy(F.col("row_key").alias(own)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(own))
    if again.limit(1).count():
        left = left.join(again, own, "left_anti").unionByName(left.join(again, own, "left_semi").dropDuplicates([own]))
    return left.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    own = private(docs, _KEY)
    keyed = docs.withColumn(own, neardup.row_key("doc_id", "text"))
    found = latent.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col=own)
    leaks = found.where("contaminated").select(F.col("doc_id").alias(own)).distinct()
    return keyed.join(leaks, own, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars brought up to date."""
    masked = docs.withColumn("text", secrets.redacted(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return masked.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global random order."""
    return mixing.replicate(docs, MIXTURE)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: Learned scores, fingerprints and a singular value decomposition have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; between stages the rows are written to the shared checkpoint folder and read again.

    The rows that a stage read are removed when the next stage has written
    its own; the last stage's input stays, as the result is read from it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
