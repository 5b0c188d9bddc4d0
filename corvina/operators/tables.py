"""Projections, lookups and string building on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_character(c: Column) -> Column:
    return F.substring(c, -1, 1)


def renamed(df: DataFrame, names: list[str]) -> DataFrame:
    """All columns renamed by place."""
    return df.toDF(*names)


def constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def ensemble_mean(outputs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Mean of the models' outputs for each id."""
    return outputs.groupBy(id_col).agg(*(F.avg(c).alias(c) for c in columns))


def prediction_string(columns: list[str]) -> Column:
    """``name value 0 0 1 1`` for each column, joined by spaces."""
    return F.concat_ws(" ", *(F.concat(F.lit(f"{c} "), F.col(c).cast("string"), F.lit(" 0 0 1 1")) for c in columns))


def decimals(c: Column, n: int) -> Column:
    return F.format_string(f"%.{n}f", c)


def map_batches(df: DataFrame, f, schema: str) -> DataFrame:
    """The rows that ``f``, from a pandas frame to a pandas frame, makes of each batch."""
    return df.mapInPandas(lambda frames: map(f, frames), schema)
