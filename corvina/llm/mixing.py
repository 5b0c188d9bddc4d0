"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture. The mean number of copies of a
document is (target documents of its source) / (documents of its source).
How often a document occurs is drawn from the Poisson distribution of that
mean, inverted at a uniform number that is a hash of seed and document id;
so a document's number depends on nothing but its id, the seed and its
source's rate, and a lost task draws the same again. The copies are dealt out
in a global order by another hash.

Defined results: a null source is a source of its own; a source without a
target weight gets the default weight; a null id is hashed as the empty
string; repeated rows are drawn alike; a source with weight 0 goes. An empty
table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import cut, private

#: The Poisson distribution is tabulated over the mean and this many standard deviations and 20 on either side.
TAIL, CHUNK = 12.0, 256
#: Copies that one row is exploded to at a time.
COPIES = 1_024
#: The columns that are added.
ADDED = ("copy", "n_copies", "rate", "shuffle_key")
#: A larger table of sources is joined by hash, in so many salts.
MAX_BROADCAST_SOURCES, SALTS = 20_000, 64


def uniform(seed: int, *cols: Column) -> Column:
    """52 bits of an md5 over seed and columns, as a number in (0, 1)."""
    key = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """Struct of low (the number before the first of the table) and cdf: cumulative probabilities of the numbers within TAIL deviations of the mean.

    Each term is exp(k ln rate - rate - ln k!); the logarithms of the
    factorials are running sums, from Stirling's series at the first number.
    What lies below the table has less than 1e-30 of the probability.
    """
    spread = F.lit(TAIL) * F.sqrt(rate) + 20
    low = F.greatest(F.floor(rate - spread), F.lit(0)).cast("long")
    ks = F.sequence(low, F.ceil(rate + spread).cast("long"))
    x = low.cast("double")
    stirling = F.when(x < 1, 0.0).otherwise(x * F.ln(x) - x + F.ln(x * (2 * math.pi)) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))))
    more = lambda acc, k: acc["log_fact"] + F.when(k > low, F.ln(k.cast("double"))).otherwise(0.0)
    term = lambda acc, k: F.exp(k * F.ln(rate) - rate - more(acc, k))
    # chunks of so many numbers are joined at a time, so that no array is copied once per number
    size = F.lit(CHUNK)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(ks) - 1) / size).cast("int")), lambda i: F.slice(ks, i * size + 1, size))
    start = F.struct(F.array().cast("array<array<double>>").alias("parts"), F.lit(0.0).alias("total"), stirling.alias("log_fact"))

    def run(acc: Column, part: Column) -> Column:
        empty = F.struct(F.array().cast("array<double>").alias("cdf"), acc["total"].alias("total"), acc["log_fact"].alias("log_fact"))
        own = F.aggregate(part, empty, lambda a, k: F.struct(F.concat(a["cdf"], F.array(a["total"] + term(a, k))).alias("cdf"), (a["total"] + term(a, k)).alias("total"), more(a, k).alias("log_fact")))
        return F.transform(F.array(own), lambda o: F.struct(F.concat(acc["parts"], F.array(o["cdf"])).alias("parts"), o["total"].alias("total"), o["log_fact"].alias("log_fact")))[0]

    return F.struct(low.alias("low"), F.flatten(F.aggregate(parts, start, run)["parts"]).alias("cdf"))


def rates(docs: DataFrame, weights: dict[str, float] | None, default_weight: float, source_col: str, epochs: float) -> DataFrame:
    """One row per source: _source, _rate, _table (low, cdf). The counts are pre-aggregated by task, so a hot source moves one row per task."""
    sizes = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    weight = F.lit(float(default_weight))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("_source") == F.lit(name), F.lit(float(value))).otherwise(weight)
    sizes = sizes.withColumn("_weight", weight)
    total = sizes.agg(F.sum("_n").alias("_all"), F.sum("_weight").alias("_weights"))
    rate = F.col("_all") * F.lit(float(epochs)) * F.col("_weight") / F.col("_weights") / F.col("_n")
    # ``total`` is one row, so this is a lookup, not a product of two tables
    return sizes.join(F.broadcast(total)).select("_source", rate.alias("_rate")).where(F.col("_rate") > 0).withColumn("_table", poisson_cdf(F.col("_rate")))


def replicate(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = 1.0,
    epochs: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """All columns of ``docs`` plus copy (from 1), n_copies, rate and shuffle_key, ordered by shuffle_key.

    The total is about ``epochs`` times the number of documents, and source s
    gets its share weights[s] / sum of weights of the sources that occur.
    Only the table of sources is joined: by broadcast if it has at most
    MAX_BROADCAST_SOURCES rows (it is counted first), else by hash of source
    and of a salt, so that a hot source isn't gathered in one task. A row of
    very many copies is dealt out in ranges of COPIES before it is exploded.

    A column of ``docs`` named like one of the four new ones would be lost,
    so it is an error; any other name is kept.
    """
    clash = sorted({c.lower() for c in docs.columns} & set(ADDED))
    if clash:
        raise ValueError(f"columns {clash} are added by this operator: rename them first")
    by = cut(rates(docs, weights, default_weight, source_col, epochs))
    count, most = by.agg(F.count(F.lit(1)), F.max("_rate")).first()
    names = {c: private(docs, c) for c in ("_u", "_source", "_rate", "_table", "_salt", "_own_salt", "_range", "_from", "_n")}
    u, source, rate, cells, salt, own_salt, part, start, n = names.values()
    by = by.select(F.col("_source").alias(source), F.col("_rate").alias(rate), F.col("_table").alias(cells))
    drawn = docs.withColumn(u, uniform(seed, F.col(id_col)))
    if count <= MAX_BROADCAST_SOURCES:
        drawn = drawn.join(F.broadcast(by), F.col(source_col).eqNullSafe(F.col(source)))
    else:
        salted = by.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = drawn.withColumn(own_salt, F.floor(F.col(u) * SALTS).cast("int"))
        drawn = drawn.join(salted, F.col(source_col).eqNullSafe(F.col(source)) & (F.col(own_salt) == F.col(salt)))
    drawn = drawn.withColumn(n, (F.col(cells)["low"] + F.size(F.filter(F.col(cells)["cdf"], lambda p: p < F.col(u)))).cast("int")).where(F.col(n) > 0)
    columns = [F.col(c) for c in docs.columns]
    if most is not None and most > COPIES:
        drawn = drawn.select(*columns, n, rate, F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / COPIES).cast("int"))).alias(part))
        drawn = drawn.repartition(F.xxhash64(F.col(id_col), F.col(part)), F.col(part))
        drawn = drawn.withColumn(start, F.col(part) * COPIES + 1)
    else:
        drawn = drawn.withColumn(start, F.lit(1))
    copies = drawn.select(*columns, F.explode(F.sequence(F.col(start), F.least(F.col(start) + (COPIES - 1), F.col(n)) if most is not None and most > COPIES else F.col(n))).alias("copy"), F.col(n).alias("n_copies"), F.col(rate).alias("rate"))
    # the content takes part, so that rows of one id don't stand together
    key = uniform(seed + 1, F.col(id_col), F.col("copy"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")) if text_col in docs.columns else F.lit(""))
    return copies.withColumn("shuffle_key", key).orderBy("shuffle_key", F.col(id_col), "copy")


def expected(rate: float, k: int) -> float:
    """P(X = k), for tests."""
    return math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
