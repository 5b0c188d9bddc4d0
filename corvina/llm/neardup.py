"""Near-duplicate texts: SimHash finds the pairs to try, the Jaccard similarity of word shingles decides.

Equal sets of shingles are one node. A similarity of 0.8 is about 39 of 256
fingerprint bits, a radius for which complete blocks of bits would be too
short to sort anything out, so nodes meet in buckets of minimal hashes
(``BANDS`` bands of ``IN_BAND``: a pair of similarity s shares none with
probability (1 - s**IN_BAND) ** BANDS, 0.0002 at 0.8). In a bucket, pivot
distance tables discard pairs and the survivors within ``RADIUS`` bits of
each other are linked loosely, by a forest of least distances (see simhash).

Loose links are verified on the whole sets. Where that leaves a loose class
in several parts, another of its links may still join them, so all its pairs
of different parts are then compared exactly, by counting common shingles
over an inverted index. A part that fills blocks of its own isn't compared
with itself: a large group of near copies costs its other texts times its
size, not its square, and no list of its pairs is ever made.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm import simhash
from corvina.llm.common import cut, join_hot, slices
from corvina.llm.components import components

#: Bands of minimal hashes, and hashes in a band.
BANDS, IN_BAND = 16, 4
#: 64-bit words of a fingerprint, and the bits by which loosely linked ones may differ.
WORDS, RADIUS = 4, 64
#: Nodes of one block of a loose class, long texts counting as one node more for so many shingles.
BLOCK, BLOCK_SHINGLES = 2_048, 1_024
#: Nodes that are broadcast to fetch their texts (they are counted first).
MAX_BROADCAST_NODES = 500_000

_ODD = (np.random.default_rng(3).integers(0, 2**63, BANDS * IN_BAND, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and text, either of which may be null."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("string"), F.col(text_col).isNull(), F.col(text_col))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words, A-Z lowered (fewer words: all of them; no words: none)."""
    ws = text.lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    joined = b" ".join(ws)
    ends = list(itertools.accumulate(len(w) + 1 for w in ws))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[min(width, len(ws)) - 1 :])], dtype=np.uint64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def node_of(own: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(own.tobytes()))


def bands(own: np.ndarray) -> list[int]:
    """One key for each band; a set without shingles has none, as it equals only itself."""
    if not len(own):
        return []
    low = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(own), 4_096):
        x = own[s : s + 4_096] * _ODD[:, None]
        low = np.minimum(low, (x ^ (x >> np.uint64(29))).min(axis=1))
    return [_signed(xxhash.xxh3_64_intdigest(low[b : b + IN_BAND].tobytes(), b)) for b in range(0, len(low), IN_BAND)]


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def joins(sets: list[np.ndarray], nodes: np.ndarray, parts: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join different parts; with two sides only those from one to the other."""
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    first = np.r_[0, np.cumsum(np.bincount(ids))]
    at = np.r_[0, np.cumsum(sizes)]
    part = np.unique(parts, return_inverse=True)[1]
    two, out = len(np.unique(side)) > 1, []
    for x in range(len(sets)):
        if two and side[x]:
            continue
        own = ids[at[x] : at[x + 1]]
        n = first[own + 1] - first[own]
        place = np.repeat(first[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.bincount(owner[place], minlength=len(sets))
        hit = both >= similarity * (sizes[x] + sizes - both) - 1e-9
        hit &= side == 1 if two else np.arange(len(sets)) > x
        for y in np.flatnonzero(hit & (part != part[x])):
            if part[y] != part[x]:
                out.append((int(nodes[x]), int(nodes[y])))
                part[part == part[y]] = part[x]
    return out


def _joined(similarity: float):
    """Sorted rows (grp, i, j, side, node, part, hashes) -> links (a, b)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, held = None, []

        def done():
            links = joins([np.frombuffer(h[3], np.uint64) for h in held], np.array([h[1] for h in held]), np.array([h[2] for h in held]), np.array([h[0] for h in held]), similarity)
            return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

        for f in frames:
            for grp, i, j, *row in f.itertuples(index=False):
                if own != (grp, i, j):
                    if held:
                        yield done()
                    own, held = (grp, i, j), []
                held.append(row)
        if held:
            yield done()

    return run


def classes(docs: DataFrame, similarity: float, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, component_id, stays of each row.

    component_id is the smallest id of the row's class, null if none of it has
    one; ``stays`` marks one row of each class, that with the smallest id, and
    rows equal to it in id and text.

    Defined results: null and empty texts have no shingles and are one class;
    a text of fewer words than a shingle is one shingle; rows of one id with
    different texts, and rows without an id, are judged each by its text; an
    empty table gives an empty table.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames):
            own = [shingles(t, shingle) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "key": f["key"], "node": [node_of(x) for x in own], "n": [len(x) for x in own], "fp": [simhash.majority(x, WORDS) for x in own], "bands": [bands(x) for x in own]})

    prints = cut(texts.mapInPandas(describe, "doc_id long, key long, node long, n long, fp binary, bands array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    nodes = cut(prints.groupBy("node").agg(first, F.count(F.lit(1)).alias("rows"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")))

    def sets(wanted: DataFrame) -> DataFrame:
        """node, hashes of the nodes wanted, each read from one row that holds it."""

        def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in slices(frames):
                yield pd.DataFrame({"node": f["node"], "hashes": [shingles(t, shingle).tobytes() for t in f["text"]]})

        wanted = cut(nodes.select("node", F.col("first.key").alias("_key")).join(wanted, "node", "left_semi"))
        if wanted.count() <= MAX_BROADCAST_NODES:
            wanted = F.broadcast(wanted)
        found = texts.join(wanted, F.col("key") == F.col("_key")).select("node", "text")
        return cut(found.mapInPandas(make, "node long, hashes binary").groupBy("node").agg(F.any_value("hashes").alias("hashes")))

    def verified(edges: DataFrame) -> DataFrame:
        own = sets(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        heads = edges.select(F.col("a").alias("node")).distinct().join(own, "node").select(F.col("node").alias("a"), F.lit(0).alias("kind"), F.col("node").alias("b"), "hashes")
        tails = edges.join(own, F.col("b") == F.col("node")).select("a", F.lit(1).alias("kind"), "b", "hashes")

        def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            head, x = None, None
            for f in frames:
                out = []
                for a, kind, b, hashes in f.itertuples(index=False):
                    y = np.frombuffer(hashes, np.uint64)
                    if kind == 0:
                        head, x = a, y
                    elif head == a and similar(x, y, similarity):
                        out.append((a, b))
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        return cut(heads.unionByName(tails).repartition("a").sortWithinPartitions("a", "kind").mapInPandas(check, "a long, b long"))

    keyed = nodes.select(F.posexplode("bands").alias("tab", "key"), F.col("node").alias("rep"), "fp")
    loose = cut(simhash.bucket_edges(keyed, RADIUS, WORDS, simhash.nearest).distinct())
    tight = verified(loose)
    parts = cut(components(tight))

    # the loose classes that verified links leave in parts
    groups = components(loose)
    groups = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    member = groups.join(parts.select("node", F.col("component").alias("part")), "node", "left").join(nodes.select("node", "n"), "node")
    member = cut(member.select(F.col("component").alias("grp"), F.coalesce("part", "node").alias("part"), "node", (1 + F.floor(F.col("n") / BLOCK_SHINGLES)).alias("weight")))
    by_part = member.groupBy("grp", "part").agg(F.sum("weight").alias("of_part"), F.count(F.lit(1)).alias("n"))
    by_group = by_part.groupBy(F.col("grp").alias("_g")).agg(F.sum("of_part").alias("of_group"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_parts"))
    open_parts = by_part.join(by_group, F.col("grp") == F.col("_g")).where("_parts > 1 and _n > 2").select(F.col("grp").alias("_g"), F.col("part").alias("_p"), "of_part", "of_group")
    member = member.join(open_parts, (F.col("grp") == F.col("_g")) & (F.col("part") == F.col("_p")))
    # a part of more than a block has blocks of its own, the others are dealt out by part
    large = F.col("of_part") > BLOCK
    split = lambda key, weight: F.pmod(F.xxhash64(key), F.ceil(F.col(weight) / BLOCK)).cast("string")
    block = F.when(large, F.concat_ws(":", F.col("part").cast("string"), split("node", "of_part"))).otherwise(F.concat_ws(":", F.lit(""), split("part", "of_group")))
    member = cut(member.select("grp", "part", "node", block.alias("block"), F.when(large, F.col("part")).alias("alone")))
    blocks = cut(member.select("grp", "block", "alone").distinct())
    other = blocks.select(F.col("grp").alias("_g"), F.col("block").alias("j"), F.col("alone").alias("_alone"))
    pairs = blocks.join(other, (F.col("grp") == F.col("_g")) & (F.col("block") <= F.col("j"))).where("alone is null or _alone is null or alone != _alone").select("grp", F.col("block").alias("i"), "j")
    dealt = pairs.select("grp", "i", "j", F.lit(0).alias("side"), F.col("i").alias("block")).unionByName(pairs.where("i != j").select("grp", "i", "j", F.lit(1).alias("side"), F.col("j").alias("block")))
    hashes = sets(member.select("node"))
    rows = member.join(dealt, ["grp", "block"]).select("grp", "i", "j", "side", "node", "part").join(hashes, "node").select("grp", "i", "j", "side", "node", "part", "hashes")
    # cut off, as are all links: two Python operators in one stage would take a worker each, and workers stay
    more = cut(rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side", "node").mapInPandas(_joined(similarity), "a long, b long"))

    linked = components(tight.unionByName(more))
    named = nodes.select("node", "first", "rows").join(linked, "node", "left").select("node", "first", "rows", F.coalesce("component", "node").alias("part"))
    least = named.groupBy("part").agg(F.min("first").alias("least"))
    named = named.join(least, "part").select("node", "rows", "least")
    out = join_hot(prints.select("doc_id", "key", "node"), named, "node", "rows")
    return out.select("doc_id", F.col("key").alias("row_key"), F.col("least.doc_id").alias("component_id"), (F.col("key") == F.col("least.key")).alias("stays"))
