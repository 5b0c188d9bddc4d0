"""Connected components of an edge list by alternating large-star and small-star.

Every round is a few aggregations and joins over (node, neighbour) rows; no
node's neighbours are ever gathered, and each round is cut off by a reliable
checkpoint. Before the rounds, every task replaces its share of the edges by
a spanning forest, so that what is dealt out is at most one edge per node
and task. No more than ``CHUNK`` edges are finished by one task, which saves
the rounds; more never come together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import cut

#: Edges that a task contracts at a time; only a bound on memory (16 MB).
CHUNK = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph, nodes that are smallest left out."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[x], parent[y])
        before = parent.copy()
        np.minimum.at(parent, parent[x], low)
        np.minimum.at(parent, parent[y], low)
        parent = parent[parent]
        if np.array_equal(parent, before):
            break
    keep = parent != np.arange(len(nodes))
    return nodes[keep], nodes[parent[keep]]


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for f in frames:
        a, b = np.concatenate([a, f["a"].to_numpy(np.int64)]), np.concatenate([b, f["b"].to_numpy(np.int64)])
        if len(a) > 2 * CHUNK:
            a, b = forest(a, b)
            if len(a) > CHUNK:  # what can't be made less goes on its way
                yield pd.DataFrame({"a": a, "b": b})
                a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(a):
        a, b = forest(a, b)
        yield pd.DataFrame({"a": a, "b": b})


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of an edge list (a long, b long); self-loops and repeats are ignored.

    Isolated nodes don't occur in an edge list and so not in the result.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut(edges.mapInPandas(_contract, "a long, b long").distinct())

    def seen(e: DataFrame) -> tuple:
        # equal sums over equal counts of edges: nothing moved
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    state = seen(edges)
    for _ in range(max_rounds):
        if state[0] <= CHUNK:
            edges = edges.coalesce(1).mapInPandas(_contract, "a long, b long") if state[0] else edges
            break
        # large-star: a node's larger neighbours go to its smallest neighbour or itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small-star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a != b").distinct())
        now = seen(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
