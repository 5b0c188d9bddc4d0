"""Triples: patterns, basic graph patterns, union, resolution of entities, classes of equal entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.operators.learners import checkpointed

TRIPLE = "s string, p string, o string"


def expand(prefixes: dict[str, str], name: str) -> str:
    """ex:a with a known prefix becomes its full form."""
    head, colon, tail = name.partition(":")
    return prefixes[head] + tail if colon and head in prefixes else name


def graph(rows: DataFrame) -> DataFrame:
    """Set semantics: a triple is in the graph once."""
    return rows.dropDuplicates()


def typed(rows: DataFrame) -> DataFrame:
    """Triples with kind, language and datatype of the object, null where absent."""
    for c in ("o_kind", "o_lang", "o_datatype"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    return graph(rows.select("s", "p", "o", "o_kind", "o_lang", "o_datatype"))


def simple_pattern(g: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Distinct values of the open positions; a pattern without any has no binding, hence an empty result."""
    fixed = {"s": s, "p": p, "o": o}
    for c, v in fixed.items():
        if v is not None:
            g = g.where(F.col(c) == v)
    free = [c for c, v in fixed.items() if v is None]
    return g.select(*free).dropDuplicates() if free else g.select("s").limit(0)


def match(g: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    """Bindings of the variables (``?x``) of one pattern, a row for each triple."""
    names: dict[str, str] = {}
    for c, v in zip("spo", pattern):
        if not v.startswith("?"):
            g = g.where(F.col(c) == v)
        elif v in names:
            g = g.where(F.col(c) == F.col(names[v]))
        else:
            names[v] = c
    return g.select(*(F.col(c).alias(v[1:]) for v, c in names.items()))


def _join(a: DataFrame, b: DataFrame) -> DataFrame:
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("patterns without a common variable")
    return a.join(b, shared)


def bgp(g: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Bindings of all patterns together: joins on their common variables, in an order that always has one."""
    left = [match(g, p) for p in patterns]
    out = left.pop(0)
    while left:
        nxt = next((x for x in left if set(x.columns) & set(out.columns)), None)
        if nxt is None:
            raise ValueError("patterns without a common variable")
        left.remove(nxt)
        out = _join(out, nxt)
    return out


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """One solution for each branch that matches; variables of only one branch are null in the other."""
    return a.unionByName(b, allowMissingColumns=True)


def bgp_with_union(g: DataFrame, patterns: list, branches: list[list]) -> DataFrame:
    return _join(bgp(g, patterns), reduce(union, (bgp(g, b) for b in branches)))


def optional(solutions: DataFrame, g: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Solutions extended by the patterns where these match; their own variables are null elsewhere."""
    more = bgp(g, patterns)
    shared = [c for c in solutions.columns if c in more.columns]
    if not shared:
        raise ValueError("patterns without a common variable")
    return solutions.join(more, shared, "left")


def aggregate(solutions: DataFrame, by: list[str], having: Column | None = None, order: list | None = None, limit: int | None = None, **aggs: Column) -> DataFrame:
    """Groups of solutions with their aggregates; then a condition on the groups, an order and a limit. Without ``by`` all are one group."""
    out = solutions.groupBy(*by).agg(*(f.alias(k) for k, f in aggs.items()))
    out = out if having is None else out.where(having)
    out = out.orderBy(*order) if order else out
    return out if limit is None else out.limit(limit)


def coverage(g: DataFrame, expected: DataFrame) -> DataFrame:
    """p, present for each expected predicate."""
    found = g.select("p").distinct().withColumn("present", F.lit(True))
    return expected.join(found, "p", "left").select("p", F.coalesce("present", F.lit(False)).alias("present"))


def resolve(names: DataFrame, labels: DataFrame, same_as: DataFrame) -> DataFrame:
    """name, resolved: its label, else the label of what it is the same as, else the name itself.

    names: name; labels: uri, label; same_as: name, uri.
    """
    own = labels.select(F.col("uri").alias("name"), F.col("label").alias("own"))
    via = same_as.join(labels, "uri").select("name", F.col("label").alias("via"))
    return names.join(own, "name", "left").join(via, "name", "left").select("name", F.coalesce("own", "via", "name").alias("resolved"))


def same_classes(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """node, canonical: smallest name reachable over equality pairs (a, b); labels jump over their own labels, so the rounds are logarithmic."""
    both = checkpointed(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("canonical")))
    for _ in range(rounds):
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("canonical").alias("m"))
        step = now.join(near, now["node"] == near["a"]).select("node", F.least("canonical", "m").alias("canonical"))
        jump = step.select(F.col("node").alias("canonical"), F.col("canonical").alias("c2"))
        new = checkpointed(step.join(jump, "canonical", "left").select("node", F.least("canonical", F.coalesce("c2", "canonical")).alias("canonical")))
        changed = new.join(now.withColumnRenamed("canonical", "old"), "node").where("canonical != old").limit(1).count()
        now = new
        if not changed:
            return now
    raise RuntimeError("the classes did not settle")
