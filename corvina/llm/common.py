"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is shared_folder(); files go with their frame where the
    session sets ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session (``local[...]``: one machine) that names none gets a
    temporary folder; elsewhere that is an error, as executors would not see it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvina-checkpoint-"))
    return sc.getCheckpointDir()


def texts(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the id and the text (null: empty), under private names, so that other columns can't clash."""
    return df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *more)


def slices(frames: Iterator[pd.DataFrame], rows: int = 1_000) -> Iterator[pd.DataFrame]:
    """The frames in parts of a few rows, for what is larger than the rows it is made from; ends with give_back()."""
    try:
        for f in frames:
            for at in range(0, len(f), rows):
                yield f.iloc[at : at + rows]
    finally:
        give_back()


def give_back() -> None:
    """Returns to the system what a worker has freed: at the end of a task it is kept for others, and waits with all it holds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only the GNU library has it
        pass


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds



def private(df: DataFrame, name: str) -> str:
    """The name, or one made of it that no column of ``df`` has (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys that join_hot calls hot, at most.
HOT_KEYS = 5_000


def join_hot(rows: DataFrame, by: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` (cut off by a checkpoint) with ``by``, which has one row per key; ``count`` tells how many rows have the key.

    Keys of many rows are dealt out by a salt. A key is hot from a share of
    the rows on, so the list of hot keys, which is broadcast, is bounded.
    """
    limit = max(256, rows.count() // HOT_KEYS)
    by = cut(by.withColumn("_chunks", F.greatest(F.ceil(F.col(count) / limit), F.lit(1)).cast("int")))
    hot = by.where("_chunks > 1").select(F.col(key).alias("_hot"), F.col("_chunks").alias("_of"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.coalesce("_of", F.lit(1))).cast("int")).drop("_row", "_hot", "_of")
    by = by.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks", count)
    return rows.join(by, [key, "_salt"]).drop("_salt")
