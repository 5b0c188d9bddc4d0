"""SimHash near-duplicates by pivot distance tables.

A fingerprint has one bit per position, set if over half of the document's
shingle hashes have it set. For a set of reference fingerprints (pivots) the
Hamming distances of every fingerprint are computed once. By the triangle
inequality two fingerprints within ``radius`` bits have no coordinate that
differs by more than ``radius``; pairs with a larger difference are
discarded, and only the survivors are compared bit by bit.

Which pairs are tried at all also follows from distances: the distances to
the zero fingerprint and to the unit fingerprints of a block of bits
determine the block, so "no difference in these coordinates" is equality of
the block's bits. If a fingerprint's bits lie in ``blocks`` blocks of which
``radius`` can be hit, ``blocks - radius`` blocks agree: every choice of
``blocks - radius`` blocks makes a table, and pairs in no common bucket of
any table are farther apart than ``radius``. This is complete. For radii too
large for that (``sampled_tables``), the tables are fixed samples of bits.

A bucket is one run of rows in a sorted partition. Within it a traversal
emits a spanning forest of the links, not all pairs. Buckets of more than
``BUCKET`` fingerprints are dealt out as pairs of chunks, each a task's work.
Equal fingerprints are one node from the start, named by the fingerprint
itself, so rows without an id and ids that repeat keep every link.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.llm.common import cut, join_hot
from corvina.llm.components import components

#: Fingerprints that one traversal holds; larger buckets are split into pairs of chunks.
BUCKET = 8_192
#: Buckets up to this size are compared all at once.
SMALL = 12
#: A list of large buckets up to this length is broadcast (it is counted first), a longer one joined by hash.
MAX_BROADCAST_BUCKETS = 100_000
#: Number of reference fingerprints of the distance table, and the seed they are drawn from.
PIVOTS, PIVOT_SEED = 8, 20_240_607
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _more(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of a hash (k=0: the hash), by the splitmix64 finaliser."""
    if not k:
        return h
    z = h + np.uint64((int(_STEP) * k) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes, shingle: int = 3, words: int = 1, seed: int = 42, distinct: bool = False) -> bytes:
    """Big-endian fingerprint of ``words`` times 64 bits.

    A-Z are lowered; words are runs without ASCII white space; shingles of
    ``shingle`` words, repeats included, are joined by spaces (fewer words:
    all of them; no words: all bits zero). With ``distinct`` a repeated
    shingle counts once.
    """
    ws = text.lower().split()
    if not ws:
        return b"\0" * 8 * words
    if len(ws) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(ws), seed)]
    else:
        joined = b" ".join(ws)
        ends = list(itertools.accumulate(len(w) + 1 for w in ws))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[shingle - 1 :])]
    if distinct:
        hashes = list(set(hashes))
    return majority(np.array(hashes, dtype=np.uint64), words)


def majority(h: np.ndarray, words: int = 1) -> bytes:
    """Bits set in over half of the hashes and of ``words - 1`` further hashes made of each; no hashes: all bits zero."""
    half, out = len(h) / 2, []
    for k in range(words):
        x = _more(h, k)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 65_536):
            ones += np.unpackbits(x[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(ones > half).tobytes())
    return b"".join(out)


def fingerprints(text: Column, shingle: int = 3, words: int = 1, distinct: bool = False) -> Column:
    """Binary fingerprint of a text column; null counts as empty."""

    @F.pandas_udf(T.BinaryType())
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(bytes(t) if t is not None else b"", shingle, words, distinct=distinct) for t in batch], dtype=object)

    return make(text.cast("binary"))


def block_tables(bits: int, blocks: int, radius: int) -> list[np.ndarray]:
    """Bit positions of each table: all choices of blocks - radius of the blocks."""
    if not 0 <= radius < blocks:
        raise ValueError("radius must be less than the number of blocks")
    parts = np.array_split(np.arange(bits), blocks)
    return [np.concatenate(c) for c in itertools.combinations(parts, blocks - radius)]


def sampled_tables(bits: int, tables: int, key_bits: int, seed: int = 5) -> list[np.ndarray]:
    """Bit positions of each table: fixed samples."""
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice(bits, key_bits, replace=False)) for _ in range(tables)]


def _keyed(tables: list[np.ndarray], words: int):
    """Rows (rep, fp) -> rows (tab, key, rep, fp), one per table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 4096):
                g = f.iloc[at : at + 4096]
                raw = np.frombuffer(b"".join(g["fp"]), np.uint8).reshape(len(g), 8 * words)
                on = np.unpackbits(raw, axis=1)
                for t, positions in enumerate(tables):
                    packed = np.packbits(on[:, positions], axis=1)
                    key = np.zeros((len(g), 8), np.uint8)
                    key[:, : packed.shape[1]] = packed
                    yield pd.DataFrame({"tab": np.int32(t), "key": key.view(">i8").ravel().astype(np.int64), "rep": g["rep"].to_numpy(), "fp": g["fp"].to_numpy()})

    return run


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Pivot table: Hamming distance of each row to each reference."""
    return np.stack([np.bitwise_count(x ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)


def link(fps: np.ndarray, reps: np.ndarray, radius: int, pivots: np.ndarray) -> tuple[list, list]:
    """Spanning forest of the links among the rows: traversal of the pivot table, each row reached once.

    The rows not yet reached stay sorted by their distance to the first
    pivot, so a row looks only at a window of them, drops those with a
    larger difference in any coordinate, and verifies the rest.
    """
    table = _distances(fps, pivots)
    order = np.argsort(table[:, 0], kind="stable")
    fps, reps, table = fps[order], reps[order], table[order]
    left = np.arange(len(reps))
    a, b = [], []
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            first = table[left, 0]
            lo, hi = np.searchsorted(first, table[x, 0] - radius, "left"), np.searchsorted(first, table[x, 0] + radius, "right")
            near = left[lo:hi]
            if not len(near):
                continue
            survives = np.flatnonzero((np.abs(table[near, 1:] - table[x, 1:]) <= radius).all(axis=1))
            if not len(survives):
                continue
            found = survives[np.bitwise_count(fps[near[survives]] ^ fps[x]).sum(axis=1) <= radius]
            if len(found):
                hit = near[found]
                a += [int(reps[x])] * len(hit)
                b += reps[hit].tolist()
                stack += hit.tolist()
                left = np.delete(left, lo + found)
    return a, b


def nearest(fps: np.ndarray, reps: np.ndarray, radius: int, pivots: np.ndarray) -> tuple[list, list]:
    """Spanning forest of the links among the rows that has the least distances: every tree grows by its nearest row."""
    table = _distances(fps, pivots)
    best, parent = np.full(len(reps), radius + 1), np.full(len(reps), -1)
    left, now = np.arange(1, len(reps)), 0
    a, b = [], []
    while len(left):
        near = left[(np.abs(table[left] - table[now]) <= radius).all(axis=1)]
        distance = np.bitwise_count(fps[near] ^ fps[now]).sum(axis=1)
        less = distance < best[near]
        best[near[less]], parent[near[less]] = distance[less], now
        at = int(best[left].argmin())
        now = int(left[at])
        if best[now] <= radius:
            a.append(int(reps[parent[now]]))
            b.append(int(reps[now]))
        left = np.delete(left, at)
    return a, b


def _linked(radius: int, words: int, forest: Callable):
    """Sorted rows (tab, key, i, j, rep, fp) -> edges (a, b)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots = np.random.default_rng(PIVOT_SEED).integers(0, 2**64, (PIVOTS, words), dtype=np.uint64)
        held: list[pd.DataFrame] = []

        def done(rows: pd.DataFrame):
            if len(rows) < 2:
                return
            fps = np.frombuffer(b"".join(rows["fp"]), ">u8").reshape(len(rows), words).astype(np.uint64)
            reps, ids = rows["rep"].to_numpy(), rows[["tab", "key", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(rows)]
            a, b = [], []
            # small buckets, by far the most, all at once: each row with those up to SMALL - 1 places on
            size = ends - starts
            rest = np.repeat(np.where(size <= SMALL, ends, starts), size) - np.arange(len(rows)) - 1
            table = _distances(fps, pivots) if (size <= SMALL).any() else None
            for step in range(1, SMALL):
                x = np.flatnonzero(rest >= step)
                if not len(x):
                    break
                x = x[(np.abs(table[x] - table[x + step]) <= radius).all(axis=1)]
                x = x[np.bitwise_count(fps[x] ^ fps[x + step]).sum(axis=1) <= radius]
                a += reps[x].tolist()
                b += reps[x + step].tolist()
            for s, e in zip(starts[size > SMALL], ends[size > SMALL]):
                x, y = forest(fps[s:e], reps[s:e], radius, pivots)
                a += x
                b += y
            return pd.DataFrame({"a": a, "b": b}, dtype="int64") if a else None

        for f in frames:
            # the last bucket of a batch may go on in the next
            last = f[["tab", "key", "i", "j"]].iloc[-1]
            tail = ((f["tab"] == last["tab"]) & (f["key"] == last["key"]) & (f["i"] == last["i"]) & (f["j"] == last["j"])).to_numpy()
            n = len(tail) - int(np.argmin(tail[::-1])) if not tail.all() else 0
            if n == 0:
                same = held and (held[-1][["tab", "key", "i", "j"]].iloc[-1] == last).all()
                if held and not same:
                    out = done(pd.concat(held))
                    held = []
                    if out is not None:
                        yield out
                held.append(f)
                continue
            out = done(pd.concat([*held, f.iloc[:n]]))
            held = [f.iloc[n:]]
            if out is not None:
                yield out
        if held:
            out = done(pd.concat(held))
            if out is not None:
                yield out

    return run


def edges(nodes: DataFrame, radius: int, words: int, tables: list[np.ndarray]) -> DataFrame:
    """Edges (a, b) between different fingerprints (rep long, fp binary); every component of the links is connected by them."""
    return bucket_edges(nodes.mapInPandas(_keyed(tables, words), "tab int, key long, rep long, fp binary"), radius, words)


def bucket_edges(keyed: DataFrame, radius: int, words: int, forest: Callable = link) -> DataFrame:
    """Edges (a, b) of the links within the buckets (tab int, key long) of rows (rep long, fp binary); each bucket's are connected by a forest."""
    # only buckets over BUCKET are listed: at most one for every so many rows
    large = cut(keyed.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET))
    number = large.count()
    if number:
        # chunk pairs (i <= j) of a bucket: a row of chunk c goes to all pairs that hold c
        keyed = keyed.join(F.broadcast(large) if number <= MAX_BROADCAST_BUCKETS else large, ["tab", "key"], "left")
        keyed = keyed.withColumn("chunks", F.coalesce(F.ceil(F.col("n") / BUCKET).cast("int"), F.lit(1)))
        keyed = keyed.withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    else:
        keyed = keyed.withColumn("c", F.lit(0)).withColumn("other", F.lit(0))
    keyed = keyed.select("tab", "key", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "rep", "fp")
    keyed = keyed.repartition("tab", "key", "i", "j").sortWithinPartitions("tab", "key", "i", "j", "rep")
    return keyed.mapInPandas(_linked(radius, words, forest), "a long, b long")


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    words: int = 1,
    radius: int = 3,
    tables: list[np.ndarray] | None = None,
    distinct: bool = False,
) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id (smallest id reachable over links, its own included).

    Defined results: null text is empty text; texts without words share the
    zero fingerprint and so a class; repeated rows give repeated rows; rows
    of one id with different texts are linked each by its own fingerprint;
    rows with a null id link like any other and get the smallest id of their
    class, null if none of it has an id; an empty table gives an empty table.
    """
    tables = tables or block_tables(64 * words, radius + 2, radius)
    prints = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text_col), shingle, words, distinct).alias("fp")))
    name = _as_long if words == 1 else F.xxhash64
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("rep", name("fp")))
    linked = components(edges(nodes.select("rep", "fp"), radius, words, tables))
    named = nodes.join(linked, nodes["rep"] == linked["node"], "left").select("fp", F.coalesce("component", "rep").alias("part"), "least", "n")
    ids = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "part").select("fp", "n", "component_id")
    return join_hot(prints, named, "fp", "n").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _as_long(fp: str) -> Column:
    """8 bytes as a signed number, one to one."""
    half = lambda at: F.conv(F.hex(F.substring(fp, at, 4)), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(5))
