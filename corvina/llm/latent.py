"""Benchmark decontamination by latent semantic retrieval.

One pass over the texts keeps, of every document, the sequence of those words
that the benchmark knows (other words can match nothing), packed into chunks
of whole documents. On these, passages are windows of ``WINDOW`` words with
half-window steps. From all of them come the inverse document frequencies and
a randomised SVD of their TF-IDF vectors together with the benchmark's own
(scaled to the same total weight, so that their directions are in the basis):
each task multiplies its passages with the sketch and sends on sums by term.

Candidates are pairs of passage and item with a cosine of at least
``MIN_COSINE`` in the latent space. A candidate is a leak if the longest
common subsequence of the item and the passage's surroundings covers
``VERBATIM`` of the item; or, for paraphrases, ``PARAPHRASE`` of it, if the
surroundings also hold ``CONTENT`` of its content words and ``ANSWER`` of
the words of its answer, the last sentence.

Items of under ``MIN_WORDS`` words (in scripts without spaces most are) have
no passage to compare; they leak where their words follow one another. Those
of under ``SHORT_CHARS`` letters and digits would be found in any text, so
they leak only as a whole document.

Only the benchmark's vocabulary, vectors and items are broadcast, at most
``MAX_ITEMS`` items or ``MAX_CHARS`` characters at a time; a larger benchmark
is searched in blocks.

Defined results: null and empty texts and items match nothing; items that
repeat an id count once; documents shorter than a window are one passage; repeated rows are judged alike; an
empty benchmark leaves everything clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import cut, give_back

WINDOW, RANK, OVERSAMPLE, SEED = 32, 128, 16, 11
MAX_ITEMS, MAX_CHARS = 20_000, 16_000_000
#: Words of a chunk: a longer document is a chunk of its own.
CHUNK = 250_000
#: Passages that are compared with the items at once, and whose vectors are summed at once.
RUN, SUM_RUN = 1_024, 16_384
#: Rows that are added one after the other, and groups of them that are added side by side, which a core's cache holds.
PIECE, SIDE = 16, 512
#: Terms in at most this share of the passages are content terms.
COMMON = 0.02
MIN_COSINE, VERBATIM, PARAPHRASE, CONTENT, ANSWER = 0.4, 0.8, 0.55, 0.6, 0.6
#: Shorter items are looked for word by word, anywhere in a text if they have so many characters.
MIN_WORDS, SHORT_CHARS = 5, 20

_WORD = re.compile(r"[^\W_]+")
#: What ends words: beyond ASCII by this expression, in ASCII by this table of bytes.
_BREAK = re.compile(r"[^\w\x00-\x7f]+")
_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_LOWER = _BYTES.lower()
_SENTENCE = re.compile(r"(?<=[.!?。？！])\s+|\n+")
_ID = "id"


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def encoded_words(text: str | None) -> list[bytes]:
    """The same words in UTF-8, for documents, of which there are many."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_LOWER).split()
    return _BREAK.sub(" ", text.lower()).encode().translate(_BYTES).split()


@dataclass
class Item:
    item_id: int
    ids: list[int]
    answer: frozenset[int]


def lcs(masks: dict[int, int], size: int, sequence: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel; masks has the places of each id in the item."""
    full = (1 << size) - 1
    v = full
    for x in sequence:
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


@dataclass
class Short:
    """An item of few words; ``whole``: it must be all of a document."""

    item_id: int
    ids: list[int]
    whole: bool


def _items(rows: list) -> tuple[dict[str, int], list[Item], list[Short]]:
    """Vocabulary (from 1; 0 is every other word), items of enough words, and the others."""
    index: dict[str, int] = {}
    items, short = [], []
    for item_id, text in rows:
        own = words(text)
        ids = [index.setdefault(w, len(index) + 1) for w in own]
        if len(ids) >= MIN_WORDS:
            last = next((s for s in reversed([words(s) for s in _SENTENCE.split(text)]) if s), [])
            items.append(Item(item_id, ids, frozenset(index[w] for w in last)))
        elif ids:
            short.append(Short(item_id, ids, sum(map(len, own)) < SHORT_CHARS))
    return index, items, short


def _verbatim(short: dict[int, list[Short]], begins: np.ndarray, ids: np.ndarray, base: np.ndarray) -> Iterator[tuple[int, int]]:
    """(document, item_id) of the short items that the documents hold; short items by their first word."""
    at = np.flatnonzero(begins[ids])
    for x, d in zip(at.tolist(), (np.searchsorted(base, at, "right") - 1).tolist()):
        for it in short[int(ids[x])]:
            end = x + len(it.ids)
            if end <= base[d + 1] and (not it.whole or x == base[d] and end == base[d + 1]) and ids[x:end].tolist() == it.ids:
                yield d, it.item_id


def _starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of all windows over concatenated documents."""
    step = WINDOW // 2
    number = np.maximum(1, -(-(sizes - WINDOW) // step) + 1)
    number[sizes == 0] = 0
    doc = np.repeat(np.arange(len(sizes)), number)
    first = np.r_[0, np.cumsum(number)[:-1]]
    at = np.arange(len(doc)) - np.repeat(first, number)
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    start = base[doc] + at * step
    return start, np.minimum(start + WINDOW, base[doc] + sizes[doc]), doc


def _weighted(m: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return m.astype(np.float32) * idf.astype(np.float32)[:, None]


def group_sums(m: np.ndarray, at: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each group the sum of the rows ``m[at[first : first + size]]``.

    Groups are added side by side, the largest first, so that those which
    have a next row are always the first ones; long groups go in pieces.
    """
    pieces = -(-size // PIECE)
    if len(size) and pieces.max() > 1:
        begin = np.cumsum(pieces) - pieces
        k = (np.arange(pieces.sum()) - np.repeat(begin, pieces)) * PIECE
        part = group_sums(m, at, np.repeat(first, pieces) + k, np.minimum(np.repeat(size, pieces) - k, PIECE))
        return group_sums(part, np.arange(len(part)), begin, pieces)
    out = np.zeros((len(size), m.shape[1]), m.dtype)
    order = np.argsort(-size.astype(np.int8), kind="stable")
    held, row = np.empty((SIDE, m.shape[1]), m.dtype), np.empty((SIDE, m.shape[1]), m.dtype)
    for s in range(0, len(order), SIDE):
        groups = order[s : s + SIDE]
        begin, rest = first[groups], -size[groups]
        n = int(np.searchsorted(rest, 0))
        np.take(m, at[begin[:n]], axis=0, out=held[:n], mode="clip")
        for j in range(1, -int(rest[0])):
            k = int(np.searchsorted(rest, -j))
            np.take(m, at[begin[:k] + j], axis=0, out=row[:k], mode="clip")
            held[:k] += row[:k]
        out[groups[:n]] = held[:n]
    return out


class Passages:
    """The windows of a chunk over its content terms.

    A window is two neighbouring cells of half its length, so each
    occurrence is added once for the two windows that hold it.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, idf: np.ndarray):
        step = WINDOW // 2
        start, end, doc = _starts(sizes)
        self.at = np.flatnonzero(idf[ids] > 0)
        self.ids, self.idf = ids[self.at], idf.astype(np.float32)
        lo, hi = np.searchsorted(self.at, start), np.searchsorted(self.at, end)
        keep = hi - lo >= 2
        self.lo, self.hi, self.start, self.end, self.doc = lo[keep], hi[keep], start[keep], end[keep], doc[keep]
        squares = np.r_[0.0, np.cumsum(idf[self.ids] ** 2)]
        self.norm = np.sqrt(np.maximum(squares[self.hi] - squares[self.lo], 1e-12)).astype(np.float32)
        # a document's windows and one more cell, which ends it
        last = np.r_[doc[1:] != doc[:-1], True][: len(doc)]
        cell = np.arange(len(doc)) + np.cumsum(last) - last
        bounds = np.zeros(len(doc) + int(last.sum()) + 1, np.int64)
        bounds[cell] = lo
        bounds[cell[last] + 1] = np.minimum(np.searchsorted(self.at, start[last] + step), hi[last])
        bounds[-1] = len(self.at)
        self.cell, self.first, self.size = cell[keep], bounds[:-1], np.diff(bounds)

    def __len__(self) -> int:
        return len(self.cell)

    def times(self, m: np.ndarray) -> np.ndarray:
        """Rows of the normalised TF-IDF matrix times m."""
        return self.times_weighted(_weighted(m, self.idf))

    def times_weighted(self, m: np.ndarray, s: int = 0, e: int | None = None) -> np.ndarray:
        """The same of the windows from s to e, for an m whose rows have the terms' weights, which all occurrences share; single precision."""
        cell = self.cell[s:e]
        if not len(cell):
            return np.empty((0, m.shape[1]), np.float32)
        a, b = cell[0], cell[-1] + 2
        sums = group_sums(m, self.ids, self.first[a:b], self.size[a:b])
        out = sums[cell - a]
        out += sums[cell + 1 - a]
        out /= self.norm[s:e, None]
        return out

    def transposed_times(self, y: np.ndarray, terms: int) -> np.ndarray:
        """The matrix's transpose times y, one row per passage."""
        out = np.zeros((terms, y.shape[1]))
        self.add_transposed(y, out)
        out *= self.idf[:, None]
        return out

    def add_transposed(self, y: np.ndarray, out: np.ndarray, s: int = 0, e: int | None = None) -> None:
        """Adds to ``out`` what the windows from s to e, whose rows are y, give to the terms, which are yet to be weighted."""
        cell = self.cell[s:e]
        if not len(cell):
            return
        a, b = cell[0], cell[-1] + 2
        y = (y / self.norm[s:e, None]).astype(np.float32, copy=False)
        cells = np.zeros((b - a, y.shape[1]), np.float32)
        cells[cell - a] = y
        cells[cell + 1 - a] += y
        ids = self.ids[self.first[a] : self.first[b - 1] + self.size[b - 1]]
        order = np.argsort(ids.astype(np.int32), kind="stable")
        ids = ids[order]
        cuts = np.r_[0, np.flatnonzero(np.diff(ids)) + 1]
        out[ids[cuts]] += group_sums(cells, np.repeat(np.arange(b - a), self.size[a:b])[order], cuts, np.diff(np.r_[cuts, len(ids)]))


def _open(sizes: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.decompress(bytes(ids)), "<i4").astype(np.int64), np.frombuffer(zstandard.decompress(bytes(sizes)), "<i8")


def _pack(docs: DataFrame, index, id_type: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = index.value.get
        ids, sizes, keys, held = [], [], [], 0

        def out():
            return pd.DataFrame([(keys, zstandard.compress(np.array(sizes, "<i8").tobytes(), 1), zstandard.compress(np.concatenate(ids).tobytes(), 1))], columns=["ids_of", "sizes", "ids"])

        for f in frames:
            for key, text in zip(f[_ID], f["text"]):
                ws = encoded_words(text)
                x = np.fromiter(map(get, ws, repeat(0)), "<i4", len(ws))
                ids.append(x)
                sizes.append(len(x))
                keys.append(None if pd.isna(key) else key)
                held += len(x)
                if held > CHUNK:
                    yield out()
                    ids, sizes, keys, held = [], [], [], 0
        if ids:
            yield out()
        del ids, sizes, keys
        give_back()

    return cut(docs.mapInPandas(run, f"ids_of array<{id_type}>, sizes binary, ids binary"))


def _frequencies(chunks: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """Number of passages with each term (place 0: unused), and of passages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(terms, np.int64), 0
        for f in frames:
            for sizes, packed in zip(f["sizes"], f["ids"]):
                ids, size = _open(sizes, packed)
                start, end, _ = _starts(size)
                n += len(start)
                at = np.flatnonzero(ids)
                if not len(at):
                    continue
                # a word counts in a window if the same word before it lies before the window
                term = ids[at].astype(np.int32)
                order = np.argsort(term, kind="stable")
                before = np.full(len(at), -1)
                again = term[order[1:]] == term[order[:-1]]
                before[order[1:][again]] = at[order[:-1][again]]
                first, last = np.searchsorted(end, at, "right"), np.searchsorted(start, at, "right")
                for k in range(int((last - first).max())):
                    w = first + k
                    inside = w < last
                    counted = inside & (before < start[np.minimum(w, len(start) - 1)])
                    df += np.bincount(term[counted], minlength=terms)
        i = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.r_[0, i], "n": np.r_[n, df[i]]})

    rows = chunks.mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # the vocabulary's size
    df = np.zeros(terms, np.int64)
    df[rows["term"]] = rows["n"]
    n = int(df[0])
    df[0] = 0
    return df, n


def _summed(chunks: DataFrame, matrix: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """AᵀA times the matrix, A being the passages of all documents.

    Sums go by blocks of a few terms, each to a partition of its own, which
    reads a block's rows from every task and holds one.
    """
    terms, width, rows = len(matrix), matrix.shape[1], 16
    shared = chunks.sparkSession.sparkContext.broadcast((matrix, idf))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, idf = shared.value
        m, total = _weighted(m, idf), np.zeros((terms, width))
        for f in frames:
            for sizes, packed in zip(f["sizes"], f["ids"]):
                p = Passages(*_open(sizes, packed), idf)
                for s in range(0, len(p), SUM_RUN):
                    p.add_transposed(p.times_weighted(m, s, s + SUM_RUN), total, s, s + SUM_RUN)
        total *= idf[:, None]
        give_back()
        for s in range(0, terms, rows):
            if total[s : s + rows].any():
                yield pd.DataFrame({"block": [s // rows], "sums": [total[s : s + rows].astype("<f8").tobytes()]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, total = None, None
        for f in frames:
            for b, blob in f.itertuples(index=False):
                x = np.frombuffer(bytes(blob), "<f8")
                if b != block:
                    if block is not None:
                        yield pd.DataFrame({"block": [block], "sums": [total.tobytes()]})
                    block, total = b, x.copy()
                else:
                    total += x
        if block is not None:
            yield pd.DataFrame({"block": [block], "sums": [total.tobytes()]})

    schema = "block int, sums binary"
    out = np.zeros((terms, width))
    for r in chunks.mapInPandas(run, schema).repartitionById(-(-terms // rows), "block").sortWithinPartitions("block").mapInPandas(add, schema).collect():  # terms * width numbers
        x, first = np.frombuffer(bytes(r["sums"]), "<f8").reshape(-1, width), r["block"] * rows
        out[first : first + len(x)] = x
    return out


def _basis(chunks: DataFrame, items: list[Item], idf: np.ndarray, passages: int, rank: int) -> np.ndarray:
    """Right singular vectors of the TF-IDF passages: terms x rank."""
    own = Passages(np.concatenate([np.array(i.ids) for i in items]), np.array([len(i.ids) for i in items]), idf)
    weight = max(1.0, passages / max(1, len(own)))
    width = min(rank + OVERSAMPLE, len(idf))
    q = np.random.default_rng(SEED).standard_normal((len(idf), width))
    for _ in range(2):  # a range finder and one power iteration
        q = np.linalg.qr(q)[0]
        b = _summed(chunks, q, idf) + weight * own.transposed_times(own.times(q), len(idf))
        small, q0, q = q.T @ b, q, b
    value, vector = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-value)[: min(rank, width)]
    return q0 @ vector[:, best[value[best] > 1e-9 * max(value.max(), 1e-300)]]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _search_block(docs: DataFrame, rows: list, id_type: str, rank: int) -> DataFrame | None:
    index, items, short = _items(rows)
    if not items and not short:
        return None
    sc = docs.sparkSession.sparkContext
    terms = len(index) + 1
    chunks = _pack(docs, sc.broadcast({w.encode("utf-8", "surrogatepass"): x for w, x in index.items()}), id_type)
    by_first: dict[int, list[Short]] = {}
    for i in short:
        by_first.setdefault(i.ids[0], []).append(i)
    begins = np.zeros(terms, bool)
    begins[list(by_first)] = True
    if items:
        df, n = _frequencies(chunks, terms)
        idf = np.log((1 + n) / (1 + df))
        content = df <= max(COMMON * n, 1)
        for i in items:
            if sum(content[x] for x in set(i.ids)) < 3:  # else it could not be found
                content[i.ids] = True
        content[0] = False
        idf = np.where(content, np.maximum(idf, 0.1), 0.0)
        basis = _basis(chunks, items, idf, n, rank)
        # an item is its windows, as a document is
        own = Passages(np.concatenate([np.array(i.ids) for i in items]), np.array([len(i.ids) for i in items]), idf)
        owner, vectors = own.doc, _unit(own.times(basis)).astype(np.float32)
    else:
        owner, vectors, basis, idf = np.empty(0, np.int64), np.empty((0, 1), np.float32), np.zeros((terms, 1)), np.zeros(terms)
    shared = sc.broadcast((items, owner, vectors, basis, idf, by_first, begins))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, owner, vectors, basis, idf, by_first, begins = shared.value
        weighted, masks = _weighted(basis, idf), []
        for it in items:
            m: dict[int, int] = {}
            for k, x in enumerate(it.ids):
                m[x] = m.get(x, 0) | 1 << k
            masks.append((m, frozenset(x for x in it.ids if idf[x] > 0), frozenset(x for x in it.answer if idf[x] > 0) or it.answer))
        rooms = np.array([max(8, len(it.ids) - WINDOW // 2) for it in items], np.int64)
        number = np.array([max(1, len(m[1])) for m in masks], np.int64)
        for f in frames:
            for keys, sizes, packed in zip(f["ids_of"], f["sizes"], f["ids"]):
                ids, size = _open(sizes, packed)
                base = np.r_[0, np.cumsum(size)]
                p = Passages(ids, size, idf)
                contents_of = p.ids.tolist()
                best: dict[int, tuple] = {}
                leaks: dict[int, set] = {}
                for s in range(0, len(p), RUN):
                    cosine = (_unit(p.times_weighted(weighted, s, s + RUN)) @ vectors.T).ravel()
                    hit = np.flatnonzero(cosine >= MIN_COSINE)
                    if not len(hit):
                        continue
                    w, v = np.divmod(hit, len(vectors))
                    # a passage and an item are a candidate once
                    pair, once = np.unique(w * len(items) + owner[v], return_index=True)
                    w, i = np.divmod(pair, len(items))
                    d = p.doc[s + w]
                    lo, hi = np.maximum(base[d], p.start[s + w] - rooms[i]), np.minimum(base[d + 1], p.end[s + w] + rooms[i])
                    a, b = np.searchsorted(p.at, lo), np.searchsorted(p.at, hi)
                    # at most so many content words can be shared
                    able = np.flatnonzero((b - a) / number[i] >= PARAPHRASE / 2)
                    for d, i, lo, hi, a, b, cos in zip(*(x[able].tolist() for x in (d, i, lo, hi, a, b, cosine[hit[once]]))):
                        it, (mask, contents, answer) = items[i], masks[i]
                        held = len(contents.intersection(contents_of[a:b]))
                        share = held / len(contents) if contents else 0.0
                        if share < PARAPHRASE / 2:
                            continue
                        near = ids[lo:hi].tolist()
                        common = lcs(mask, len(it.ids), near) / len(it.ids)
                        answered = len(answer.intersection(near)) / len(answer) if answer else 0.0
                        leak = common >= VERBATIM or common >= PARAPHRASE and share >= CONTENT and answered >= ANSWER
                        if leak:
                            leaks.setdefault(d, set()).add(it.item_id)
                        found = (leak, common, answered, cos, it.item_id)
                        if d not in best or found[:4] > best[d][:4] or found[:4] == best[d][:4] and found[4] < best[d][4]:
                            best[d] = found
                for d, item_id in _verbatim(by_first, begins, ids, base):
                    leaks.setdefault(d, set()).add(item_id)
                    found = (True, 1.0, 1.0, 1.0, item_id)
                    if d not in best or found[:4] > best[d][:4] or found[:4] == best[d][:4] and item_id < best[d][4]:
                        best[d] = found
                none = (False, 0.0, 0.0, 0.0, None)
                got = [best.get(d, none) for d in range(len(size))]
                yield pd.DataFrame({_ID: list(keys), "contaminated": [bool(g[0]) for g in got], "leaked": [sorted(leaks.get(d, ())) for d in range(len(size))], "item_id": pd.array([g[4] for g in got], "Int64"), "cosine": [g[3] for g in got], "lcs_share": [g[1] for g in got], "answer_share": [g[2] for g in got]})

    return chunks.mapInPandas(run, f"{_ID} {id_type}, contaminated boolean, leaked array<long>, item_id long, cosine double, lcs_share double, answer_share double")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int = RANK) -> DataFrame:
    """doc_id, contaminated, n_items, item_id, cosine, lcs_share, answer_share: one row for each of ``docs``; item_id and what follows are of the best match."""
    own = docs.select(F.col(id_col).alias(_ID), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    n, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // MAX_ITEMS), -(-chars // MAX_CHARS))
    searched, numbered = own, None
    if blocks > 1:
        # what the blocks find is put together by row, as ids may repeat or be null; the numbers are fixed by a checkpoint
        numbered = cut(own.withColumn("row", F.monotonically_increasing_id()))
        searched, id_type = numbered.select(F.col("row").alias(_ID), "text"), "bigint"
    found = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()
        part = _search_block(searched, rows, id_type, rank)
        if part is not None:
            found.append(part)
    if not found:
        return own.select(F.col(_ID).alias("doc_id"), F.lit(False).alias("contaminated"), F.lit(0).alias("n_items"), F.lit(None).cast("long").alias("item_id"), *(F.lit(0.0).alias(c) for c in ("cosine", "lcs_share", "answer_share")))
    out = found[0]
    if len(found) > 1:
        for more in found[1:]:
            out = out.unionByName(more)
        best = F.max_by(F.struct("item_id", "cosine", "lcs_share", "answer_share"), F.struct("contaminated", "lcs_share", "answer_share", "cosine"))
        out = out.groupBy(_ID).agg(F.max("contaminated").alias("contaminated"), F.array_distinct(F.flatten(F.collect_list("leaked"))).alias("leaked"), best.alias("b")).select(_ID, "contaminated", "leaked", "b.*")
    if numbered is not None:
        out = out.withColumnRenamed(_ID, "row").join(numbered.select("row", _ID), "row").select(_ID, *(c for c in out.columns if c != _ID))
    return out.select(F.col(_ID).alias("doc_id"), "contaminated", F.size("leaked").alias("n_items"), "item_id", "cosine", "lcs_share", "answer_share")
