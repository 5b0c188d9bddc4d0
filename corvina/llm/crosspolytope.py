"""Approximate nearest neighbours by cross-polytope hashing.

A hash is a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) and the signed axis nearest to the rotated vector. A table's
bucket is the concatenation of so many hashes that it holds about ``BUCKET``
vectors, however many there are; the last hash looks at some of its axes only,
to make up the number of bits. Queries probe the buckets with the smallest
sum of squared gaps between their best axis and the bucket's. How many they
probe is tuned: for a bounded sample of ``TUNING`` queries the exact
neighbours are computed, and the fewest probes that find ``RECALL`` of them
are taken for all. Vectors of unequal length get one more coordinate that
makes them equally long, so that the largest inner product is the nearest
direction. Candidates are ranked by the exact inner product, in double
precision, of the original vectors.

Buckets are dealt out to cells. A task holds the queries that probe its cell,
reads the cell's vectors as a stream and keeps the best of each query, so no
bucket is gathered and no pair is emitted that can't matter. Buckets with
many vectors are dealt out in chunks; their list is bounded by ``HOT``.

Equal vectors are one node with its k + 1 smallest ids: larger ids can never
be among the k nearest, as ties go to smaller ids. Queries that find fewer
than k are answered exactly, in blocks, so that a result is short only if the
table is.

Defined results: vectors that are null, zero, hold null or non-finite
components, or have another length than most, take no part; repeated rows
count once; an id with several vectors is as near as the nearest of them and
is listed once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm.common import cut

TABLES, SEED = 8, 7
#: Vectors of a bucket, on average.
BUCKET = 64
#: Queries of the sample that tunes the number of probes, and the recall it has to reach.
TUNING, RECALL = 256, 0.95
#: Numbers in the vectors of one cell.
CELL = 4_000_000
#: Buckets that are called hot, at most.
HOT = 20_000
#: Queries that are rotated at a time; pairs that are held besides the best of each query.
BATCH, HELD = 512, 50_000
#: Queries and vectors of one product.
PRODUCT = 1_024
#: Up to this width a rotation is kept as the matrix that its transforms make of the unit vectors.
DENSE = 256


def valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast transform of the rows; their length is a power of two."""
    rows, n = x.shape
    h = 1
    while h < n:
        x = x.reshape(rows, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, n)
        h *= 2
    return x / np.sqrt(n)


class Hashes:
    """Hashes of all tables; ``longest`` is the largest norm, ``even`` if all norms are as good as equal, 2**bits the buckets of a table."""

    def __init__(self, dim: int, longest: float, even: bool, tables: int, bits: int, seed: int):
        self.longest, self.even, self.tables, self.bits = longest, even, tables, bits
        self.width = 1 << max(1, (dim + (not even) - 1).bit_length())
        whole, rest = divmod(bits, self.width.bit_length())  # a hash over all axes has log2(2 * width) bits
        self.axes = [self.width] * whole + ([1 << (rest - 1)] if rest else [])
        self.matrices: dict = {}
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, len(self.axes), 3, self.width))

    def directions(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        out = np.zeros((len(x), self.width))
        if self.even or query:
            out[:, : x.shape[1]] = x / norm
        else:
            out[:, : x.shape[1]] = x / self.longest
            out[:, x.shape[1]] = np.sqrt(np.maximum(0.0, 1.0 - (norm[:, 0] / self.longest) ** 2))
        return out

    def _transformed(self, d: np.ndarray, table: int, j: int) -> np.ndarray:
        for s in self.signs[table, j]:
            d = hadamard(d * s)
        return d[:, : self.axes[j]]

    def _rotated(self, d: np.ndarray, table: int, j: int) -> np.ndarray:
        if self.width > DENSE:
            return self._transformed(d, table, j)
        if (table, j) not in self.matrices:
            self.matrices[table, j] = self._transformed(np.eye(self.width), table, j)
        return d @ self.matrices[table, j]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"matrices": {}}

    def buckets(self, d: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table; the table's number is in front."""
        out = np.empty((len(d), self.tables), np.int64)
        for t in range(self.tables):
            key = np.full(len(d), t, np.int64)
            for j, n in enumerate(self.axes):
                y = self._rotated(d, t, j)
                a = np.abs(y).argmax(axis=1)
                key = key * 2 * n + 2 * a + (np.take_along_axis(y, a[:, None], axis=1)[:, 0] > 0)
            out[:, t] = key
        return out

    def probes(self, d: np.ndarray, number: int) -> np.ndarray:
        """The ``number`` best buckets of each row in each table, best first within the table."""
        number = min(number, 1 << self.bits)
        out = np.empty((len(d), self.tables, number), np.int64)
        for t in range(self.tables):
            gap, key = np.zeros((len(d), 1)), np.full((len(d), 1), t, np.int64)
            for j, n in enumerate(self.axes):
                y = self._rotated(d, t, j)
                signed = np.stack([-y, y], axis=2).reshape(len(d), -1)
                own = (signed.max(axis=1, keepdims=True) - signed) ** 2
                axis = np.argsort(own, axis=1, kind="stable")[:, :number]
                own = np.take_along_axis(own, axis, axis=1)
                # a pair of places has (i + 1) * (j + 1) pairs that are as good or better
                x, z = np.nonzero(np.outer(np.arange(1, gap.shape[1] + 1), np.arange(1, own.shape[1] + 1)) <= number)
                gap, key = gap[:, x] + own[:, z], key[:, x] * 2 * n + axis[:, z]
                order = np.argsort(gap, axis=1, kind="stable")[:, :number]
                gap, key = np.take_along_axis(gap, order, axis=1), np.take_along_axis(key, order, axis=1)
            out[:, t] = key
        return out.reshape(len(d), -1)


def tuned(hashes: Hashes, queries: np.ndarray, near: np.ndarray, recall: float) -> int:
    """The fewest probes (of 1, 2, 3, 4, 6, 8, 12...) with which the queries find that share of ``near``, their neighbours by row."""
    homes = hashes.buckets(hashes.directions(near, False))
    for number in (1, 2, 3, *(n for i in range(2, hashes.bits) for n in (1 << i, 3 << (i - 1)))):
        found = 0
        for s in range(0, len(queries), 64):
            p = hashes.probes(hashes.directions(queries[s : s + 64], True), number)
            found += sum(bool(np.isin(h, q).any()) for h, q in zip(homes[s : s + 64], p))
        if found >= recall * len(queries):
            return number
    return 1 << hashes.bits


def _cell(slot: np.ndarray, chunk: np.ndarray, cells: int) -> np.ndarray:
    z = slot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + chunk.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(cells)).astype(np.int32)


def _matrix(blobs, dtype: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype).reshape(-1, dim).astype(np.float64)


class _Cell:
    """The queries of a cell and the best that they have found."""

    def __init__(self, k: int):
        self.k, self.nodes, self.vecs, self.slots = k, [], [], []
        self.y, self.held, self.size = None, [], 0

    def ready(self, dtype: str, dim: int) -> bool:
        if self.y is None and self.nodes:
            self.y = _matrix(self.vecs, dtype, dim)
            slot = np.concatenate(self.slots)
            order = np.argsort(slot, kind="stable")
            self.slot, self.query = slot[order], np.repeat(np.arange(len(self.slots)), [len(s) for s in self.slots])[order]
            self.least = np.full(len(self.nodes), -np.inf)
        return self.y is not None

    def meet(self, slot: int, x: np.ndarray, nodes: np.ndarray, ids: np.ndarray, first: np.ndarray) -> None:
        lo, hi = np.searchsorted(self.slot, [slot, slot + 1])
        for a in range(lo, hi, PRODUCT):
            for b in range(0, len(x), PRODUCT):
                self._product(self.query[a : min(hi, a + PRODUCT)], x[b : b + PRODUCT], nodes[b : b + PRODUCT], ids, first[b : b + PRODUCT + 1])

    def _product(self, q: np.ndarray, x: np.ndarray, nodes: np.ndarray, ids: np.ndarray, first: np.ndarray) -> None:
        near = self.y[q] @ x.T
        least = self.least[q]
        if len(x) > 2 * self.k:
            least = np.maximum(least, np.partition(near, len(x) - self.k, axis=1)[:, len(x) - self.k])
        # sums of another order can differ in the last bits
        r, c = np.nonzero(near >= (least - 1e-9 * np.abs(least).clip(1, 1e9))[:, None])
        if len(r):
            score = (self.y[q[r]] * x[c]).sum(axis=1)
            n = first[c + 1] - first[c]
            at = np.repeat(first[c] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            self.held.append((np.repeat(q[r], n), ids[at], np.repeat(score, n), np.repeat(nodes[c], n)))
            self.size += len(at)
            if self.size > 2 * self.k * len(self.nodes) + HELD:
                self.best()

    def best(self) -> list[np.ndarray]:
        """Query, id, score and node of the k best ids of each query."""
        if not self.held:
            return [np.empty(0, np.int64)] * 4
        q, i, s, n = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((-s, i, q))
        q, i, s, n = q[order], i[order], s[order], n[order]
        new = np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])]
        q, i, s, n = q[new], i[new], s[new], n[new]
        order = np.lexsort((i, -s, q))
        q, i, s, n = q[order], i[order], s[order], n[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        keep = rank < self.k
        self.least[q[rank == self.k - 1]] = s[rank == self.k - 1]
        self.held, self.size = [(q[keep], i[keep], s[keep], n[keep])], int(keep.sum())
        return list(self.held[0])


def _search(k: int, dtype: str, dim: int):
    """Sorted rows (cell, kind, slot, node, vec, ids, slots), queries before vectors -> (query, vec_id, score, node), at most k for each query and cell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, cell = None, None

        def done():
            q, i, s, n = cell.best()
            return pd.DataFrame({"query": np.array(cell.nodes, np.int64)[q], "vec_id": i, "score": s.astype(float), "node": n})

        for f in frames:
            ids = f[["cell", "kind"]].to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(f)]):
                g = f.iloc[s:e]
                if ids[s, 0] != own:
                    if cell is not None and cell.held:
                        yield done()
                    own, cell = ids[s, 0], _Cell(k)
                if ids[s, 1] == 0:
                    cell.nodes += g["node"].tolist()
                    cell.vecs += g["vec"].tolist()
                    cell.slots += [np.asarray(x, np.int64) for x in g["slots"]]
                elif cell.ready(dtype, dim):
                    x, nodes, slot = _matrix(g["vec"], dtype, dim), g["node"].to_numpy(), g["slot"].to_numpy()
                    members = [np.asarray(m, np.int64) for m in g["ids"]]
                    flat, first = np.concatenate(members), np.r_[0, np.cumsum([len(m) for m in members])]
                    runs = np.flatnonzero(slot[1:] != slot[:-1]) + 1
                    for a, b in zip(np.r_[0, runs], np.r_[runs, len(slot)]):
                        cell.meet(int(slot[a]), x[a:b], nodes[a:b], flat, first[a : b + 1])
        if cell is not None and cell.held:
            yield done()

    return run


_ROWS = "cell int, kind int, slot long, node long, vec binary, ids array<long>, slots array<long>"
_NAMES = ["cell", "kind", "slot", "node", "vec", "ids", "slots"]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    recall: float = RECALL,
    seed: int = SEED,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each id with ``is_query``, itself excluded."""
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    dtype, sc = "<f4" if single else "<f8", vectors.sparkSession.sparkContext
    named = vectors.where(F.col(id_col).isNotNull() & valid(F.col(vector_col)))
    rows = named.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"), is_query.alias("asks"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dim = sizes[0]["d"] if sizes else 1

    def binary(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack(f["v"].to_numpy()).astype(dtype) + 0.0  # no negative zeros
            yield pd.DataFrame({"id": f["id"], "vec": [r.tobytes() for r in x], "asks": f["asks"], "norm": np.linalg.norm(x.astype(np.float64), axis=1)})

    rows = rows.where(F.size("v") == dim).mapInPandas(binary, "id long, vec binary, asks boolean, norm double")
    rows = cut(rows.groupBy("vec", "id").agg(F.coalesce(F.max("asks"), F.lit(False)).alias("asks"), F.max("norm").alias("norm")))
    smallest = rows.withColumn("rn", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("rn") <= k + 1)
    nodes = cut(smallest.groupBy("vec").agg(F.collect_list("id").alias("ids"), F.max("norm").alias("norm")).withColumn("node", F.xxhash64("vec")))
    count, longest, shortest = nodes.agg(F.count(F.lit(1)), F.max("norm"), F.min("norm")).first()
    asking = cut(rows.where("asks").select(F.col("id").alias("query_id"), F.xxhash64("vec").alias("query"), "vec"))
    queries = cut(asking.groupBy(F.col("query").alias("node")).agg(F.any_value("vec").alias("vec")))
    best = lambda by, least: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id")) <= least

    def searched(rows: DataFrame) -> DataFrame:
        """The k + 1 best ids of each query (itself is one), from the rows of all cells."""
        found = rows.repartition("cell").sortWithinPartitions("cell", "kind", "slot").mapInPandas(_search(k + 1, dtype, dim), "query long, vec_id long, score double, node long")
        found = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"), F.max_by("node", "score").alias("node"))
        return found.withColumn("top", best("query", k + 1)).where("top").drop("top")

    def exact(asks: DataFrame) -> DataFrame:
        """Every vector for every query, in blocks; only for few queries."""
        cells = max(1, -(-count * dim // CELL))
        data = nodes.select(F.pmod(F.hash("node"), F.lit(cells)).cast("int").alias("cell"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("slot"), "node", "vec", "ids", F.lit(None).cast("array<long>").alias("slots"))
        asks = asks.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("slot"), "node", "vec", F.lit(None).cast("array<long>").alias("ids"), F.array(F.lit(0).cast("long")).alias("slots"))
        return searched(data.unionByName(asks))

    # the sample that tells how many buckets to probe
    hashes = Hashes(dim, longest or 1.0, not count or longest - shortest <= 1e-3 * longest, tables, max(1, round(np.log2(max(1, count) / BUCKET))), seed)
    sample = cut(queries.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(TUNING))
    truth = exact(sample).join(sample.select(F.col("node").alias("query"), F.col("vec").alias("asked")), "query").join(nodes.select("node", "vec"), "node").where("vec != asked").select("asked", "vec").collect()  # at most TUNING * (k + 1) rows
    probes = tuned(hashes, _matrix([bytes(r["asked"]) for r in truth], dtype, dim), _matrix([bytes(r["vec"]) for r in truth], dtype, dim), recall) if truth else 1
    shared = sc.broadcast(hashes)

    def named_buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = shared.value
        for f in frames:
            for s in range(0, len(f), BATCH):
                g = f.iloc[s : s + BATCH]
                yield pd.DataFrame({"node": g["node"], "vec": g["vec"], "ids": g["ids"], "slots": list(h.buckets(h.directions(_matrix(g["vec"], dtype, dim), False)))})

    placed = cut(nodes.select("node", "vec", "ids").mapInPandas(named_buckets, "node long, vec binary, ids array<long>, slots array<long>"))
    cells = max(1, -(-count * tables * dim // CELL))
    limit = max(4 * BUCKET, CELL // (4 * dim), count * tables // HOT)
    hot = placed.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).collect()  # at most HOT rows
    many = sc.broadcast((np.array(sorted(r["slot"] for r in hot), np.int64), np.array([-(-r["n"] // limit) for r in sorted(hot, key=lambda r: r["slot"])], np.int64)))

    def chunks_of(slot: np.ndarray) -> np.ndarray:
        known, chunks = many.value
        out = np.ones(len(slot), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, slot), len(known) - 1)
            out = np.where(known[at] == slot, chunks[at], 1)
        return out

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            slot = np.concatenate([np.asarray(x, np.int64) for x in f["slots"]])
            node = np.repeat(f["node"].to_numpy(np.int64), tables)
            chunk = (node.astype(np.uint64) >> np.uint64(7)) % chunks_of(slot).astype(np.uint64)
            vec, ids, none = (np.repeat(f[c].to_numpy(), tables) for c in ("vec", "ids", "node"))
            yield pd.DataFrame({"cell": _cell(slot, chunk, cells), "kind": np.int32(1), "slot": slot, "node": none, "vec": vec, "ids": ids, "slots": np.full(len(slot), None)}, columns=_NAMES)

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = shared.value
        for f in frames:
            for s in range(0, len(f), BATCH):
                out = []
                g = f.iloc[s : s + BATCH]
                for node, vec, slot in zip(g["node"], g["vec"], h.probes(h.directions(_matrix(g["vec"], dtype, dim), True), probes)):
                    chunks = chunks_of(slot)
                    each = np.repeat(slot, chunks)
                    cell = _cell(each, np.arange(len(each)) - np.repeat(np.r_[0, np.cumsum(chunks)[:-1]], chunks), cells)
                    order = np.argsort(cell, kind="stable")
                    cell, each = cell[order], each[order]
                    cuts = np.flatnonzero(np.diff(cell)) + 1
                    out += [(int(cell[a]), 0, 0, node, vec, None, np.unique(each[a:b])) for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(cell)])]
                yield pd.DataFrame(out, columns=_NAMES)

    found = cut(searched(placed.mapInPandas(dealt, _ROWS).unionByName(queries.mapInPandas(asked, _ROWS))))
    enough = found.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
    short = cut(queries.join(enough, queries["node"] == F.col("query"), "left_anti"))
    if short.limit(1).count():
        found = found.join(short.select(F.col("node").alias("query")), "query", "left_anti").unionByName(exact(short))
    out = asking.select("query_id", "query").join(found.select("query", "vec_id", "score"), "query").where("vec_id != query_id")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
