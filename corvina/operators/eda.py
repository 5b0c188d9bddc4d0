"""Exploratory statistics, each as a DataFrame; plots are given as the data to draw."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stack(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long rows (column, x)."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("e")).select("e.*")


def _by_column(df: DataFrame, columns: list[str], **aggs) -> DataFrame:
    """One pass over the table; then a row for each column."""
    row = df.agg(*(f(F.col(c)).alias(f"{c}__{k}") for c in columns for k, f in aggs.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{c}__{k}").alias(k) for k in aggs)) for c in columns))).alias("e")).select("e.*")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, mean, std (of a sample), min, q25, q50, q75 (interpolated), max."""
    d = lambda f: lambda c: f(c.cast("double"))
    # one map of values for all three quartiles
    quartiles = lambda c: F.percentile(c, F.array(*(F.lit(p) for p in (0.25, 0.5, 0.75))))
    out = _by_column(df, columns, count=F.count, mean=d(F.avg), std=d(F.stddev_samp), min=d(F.min), q=quartiles, max=d(F.max))
    return out.select("column", "count", "mean", "std", "min", *(F.col("q")[i].alias(f"q{25 * (i + 1)}") for i in range(3)), "max")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _by_column(df, columns or df.columns, n_null=lambda c: F.count_if(c.isNull()))


def null_map(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    return df.select(id_col, *(F.col(c).isNull().alias(f"{c}_null") for c in columns))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n: occurrences beyond the first of rows that are equal in all columns (nulls are equal)."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def counts_of_counts(df: DataFrame, column: str) -> DataFrame:
    return value_counts(df, column).select("n").distinct()


def outlier_bound(df: DataFrame, columns: list[str], k: float = 3.0) -> DataFrame:
    return _by_column(df, columns, bound=lambda c: F.avg(c) + k * F.stddev_samp(c.cast("double")))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of all pairs, rows with nulls left out pair by pair; one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    both = [(a, b, i) for i, (a, b) in enumerate(pairs)] + [(b, a, i) for i, (a, b) in enumerate(pairs) if a != b]
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for a, b, i in both))).alias("e")).select("e.*")


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """row, one column c_<value> for each value: counts, zero where there are none."""
    return df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(f"c_{v}") for v in values))


def crosstab_summary(table: DataFrame, key: str) -> DataFrame:
    """column, count, sum, mean, std, min, q25, q50, q75, max over the cells of a crosstab; empty cells count as zero."""
    columns = [c for c in table.columns if c != key]
    return describe(table, columns).join(F.broadcast(_by_column(table, columns, sum=F.sum)), "column")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin (from 0), low, high, n; equal widths from the smallest to the largest value, which falls in the last bin."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / width)))
    counted = x.join(F.broadcast(ends)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ends.select("lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def box(df: DataFrame, by: str, column: str) -> DataFrame:
    """by, q25, q50, q75, low and high whisker (last values within 1.5 interquartile ranges), n_outliers."""
    q = df.groupBy(by).agg(F.percentile(F.col(column), F.array(*(F.lit(p) for p in (0.25, 0.5, 0.75)))).alias("q"))
    q = q.select(by, *(F.col("q")[i].alias(f"q{25 * (i + 1)}") for i in range(3)))
    x = df.select(by, F.col(column).cast("double").alias("x")).join(F.broadcast(q), by)
    reach = (F.col("q75") - F.col("q25")) * 1.5
    inside = F.col("x").between(F.col("q25") - reach, F.col("q75") + reach)
    return x.groupBy(by, "q25", "q50", "q75").agg(F.min(F.when(inside, F.col("x"))).alias("low"), F.max(F.when(inside, F.col("x"))).alias("high"), F.count_if(~inside).alias("n_outliers"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Per cent of each value. The window is over the values, which are few, not over rows."""
    n = value_counts(df, column)
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select(column, "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def density(df: DataFrame, by: str, column: str, points: int = 32) -> DataFrame:
    """by, i, point, density: Gaussian kernel with Scott's bandwidth, exact, on a common grid of points numbered from 0.

    Equal values are counted first; each distinct value then adds to all
    points, summed where it is before anything is shuffled. Groups without
    spread have no density.
    """
    x = df.select(by, F.col(column).cast("double").alias("x")).where("x is not null")
    values = x.groupBy(by, "x").agg(F.count(F.lit(1)).alias("k"))
    stats = x.groupBy(by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("s")).where("s > 0")
    ends = stats.agg(F.min("lo").alias("glo"), F.max("hi").alias("ghi"))
    point = F.col("glo") + F.col("i") * (F.col("ghi") - F.col("glo")) / (points - 1)
    h = F.col("s") * F.pow("n", F.lit(-0.2))
    grid = values.join(stats, by).join(F.broadcast(ends)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("point", point)
    kernel = F.exp(-0.5 * F.pow((F.col("point") - F.col("x")) / h, F.lit(2.0))) / (h * 2.5066282746310002)
    return grid.groupBy(by, "i", "point").agg(F.sum(F.col("k") * kernel / F.col("n")).alias("density"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def flag(condition: Column, yes: str, no: str) -> Column:
    return F.when(condition, yes).otherwise(no)


def first_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("pos", r).where(F.col("pos") <= n)
