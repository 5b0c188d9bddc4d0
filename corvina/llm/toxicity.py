"""Toxic spans and document scores from a linear-chain conditional random field.

Fitting uses a bounded sample of labelled rows (``MAX_TOXIC`` toxic and
``MAX_CLEAN`` clean ones, the first by a hash, of ``MAX_CHARS`` characters in
all). One half of it tells how strongly words and their prefixes go with
toxic documents. Labels are per document, so the tokens of the other half
that have such evidence in toxic documents are the first labelled ones; a
two-label CRF is trained on them, labels the tokens of the toxic documents
anew, and is trained again on these labels. Its features are the evidence of
a token's word, of its prefixes, and of its neighbours, besides transitions
and start. Gradient ascent on the conditional likelihood goes through the
whole half in batches of whole documents. A logistic model turns the
marginals of a document into a score.

Scoring is one pass over the texts: tokens become evidence levels, and
forward-backward runs over all tokens of a batch at once, as a two-level scan
over 2x2 matrices in which a document's first token resets the chain. Only
the fitted model, whose size the sample bounds, is broadcast.

Offending offsets are the tokens whose marginal reaches ``SPAN_AT``.

Defined results: null and empty texts score as documents without toxic
tokens; documents are scored whole, whatever their length; repeated rows
score alike; labels that are null, or of unknown documents, teach nothing; a
sample that lacks one of the classes gives its prior as the score of all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.llm.common import give_back

#: Bounds of the labelled sample: rows of either class, and characters of all.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 3_000, 5_000, 64_000_000
#: A feature needs so many documents of the sample.
SUPPORT = 5
#: Evidence levels: lower confidence bounds of a feature's log-odds; level 0 is below the first.
LEVELS = np.array([0.5, 1.0, 1.5, 2.0, 3.0, 4.0])
#: Tokens from this level on are first labelled toxic in toxic documents.
TOXIC_LEVEL = 4
#: Standard errors by which log-odds are lowered; tokens of a training batch, and passes with labels of their own.
CONFIDENCE, TRAIN_TOKENS, PASSES = 2.0, 300_000, 2
#: A token's features: evidence of its word, of its prefixes, of the token before and of the one after.
KINDS = 4
PREFIXES = (4, 5, 6, 7, 8)
#: Tokens of one scan; a longer document is a scan of its own.
SCAN = 100_000
REMEMBERED, LONGEST = 400_000, 64
#: Marginals from here on make a span.
SPAN_AT = 0.5

_TOKEN = re.compile(r"[^\W\d_]+")


def _features(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in PREFIXES if k < len(word))]


@dataclass
class Model:
    levels: dict[str, int] = field(default_factory=dict)
    emission: np.ndarray = field(default_factory=lambda: np.zeros(KINDS * (len(LEVELS) + 1)))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    document: np.ndarray = field(default_factory=lambda: np.zeros(5))


class _Levels(dict):
    """Evidence of a token, remembered: level of its word times the number of levels, plus that of its prefixes."""

    def __init__(self, levels: dict[str, int]):
        super().__init__()
        self.levels = levels

    def __missing__(self, token: str) -> int:
        get = self.levels.get
        word, *prefixes = _features(token.lower())
        level = get(word, 0) * (len(LEVELS) + 1) + max((get(f, 0) for f in prefixes), default=0)
        if len(token) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = level
        return level


def forward_backward(level: np.ndarray, first: np.ndarray, m: Model, pairs: bool = False):
    """Marginals of label 1 for each token of a chain of documents; ``first`` marks their first tokens.

    ``level`` has the token's feature, or a row of its features: places in ``m.emission``.

    With ``pairs`` also the expected number of each transition inside documents.
    """
    n, width = len(level), 128
    rows = -(-n // width)
    own = m.emission[level]
    t, e1 = np.exp(m.transition), np.exp(own if own.ndim == 1 else own.sum(axis=1))
    # mat[y', y]: weight of going from y' to y and of the token's label y; a document's start forgets y'
    mat = np.empty((2, 2, rows * width))
    for y0 in (0, 1):
        mat[y0, 0, :n] = np.where(first, 1.0, t[y0, 0])
        mat[y0, 1, :n] = np.where(first, np.exp(m.start), t[y0, 1]) * e1
    mat[:, :, n:] = np.eye(2)[:, :, None]
    mat = mat.reshape(2, 2, rows, width)
    p = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, rows)).copy()
    for j in range(width):
        p = np.einsum("abr,bcr->acr", p, mat[:, :, :, j])
        p /= p.sum(axis=(0, 1))
    into, a = np.empty((2, rows)), (0.5, 0.5)
    chunks = p.transpose(2, 0, 1).reshape(rows, 4).tolist()
    for r, (p00, p01, p10, p11) in enumerate(chunks):
        into[:, r] = a
        x, y = a[0] * p00 + a[1] * p10, a[0] * p01 + a[1] * p11
        a = (x / (x + y), y / (x + y))
    out, b = np.empty((2, rows)), (0.5, 0.5)
    for r in range(rows - 1, -1, -1):
        out[:, r] = b
        p00, p01, p10, p11 = chunks[r]
        x, y = p00 * b[0] + p01 * b[1], p10 * b[0] + p11 * b[1]
        b = (x / (x + y), y / (x + y))
    alpha, beta = np.empty((2, rows, width)), np.empty((2, rows, width))
    a = into
    for j in range(width):
        a = np.stack([a[0] * mat[0, 0, :, j] + a[1] * mat[1, 0, :, j], a[0] * mat[0, 1, :, j] + a[1] * mat[1, 1, :, j]])
        a /= a.sum(axis=0)
        alpha[:, :, j] = a
    b = out
    for j in range(width - 1, -1, -1):
        beta[:, :, j] = b
        b = np.stack([mat[0, 0, :, j] * b[0] + mat[0, 1, :, j] * b[1], mat[1, 0, :, j] * b[0] + mat[1, 1, :, j] * b[1]])
        b /= b.sum(axis=0)
    alpha, beta = alpha.reshape(2, -1)[:, :n], beta.reshape(2, -1)[:, :n]
    one, zero = alpha[1] * beta[1], alpha[0] * beta[0]
    marginal = one / (one + zero)
    if not pairs:
        return marginal
    inner = np.flatnonzero(~first)
    inner = inner[inner > 0]
    flat = mat.reshape(2, 2, -1)[:, :, inner]
    xi = alpha[:, None, inner - 1] * flat * beta[None, :, inner]
    return marginal, (xi / xi.sum(axis=(0, 1))).sum(axis=2)


def _document_features(p: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: bias, P(some token toxic), P(two or more), log of the expected number, expected share."""
    out = np.zeros((len(sizes), 5))
    out[:, 0] = 1.0
    has = sizes > 0
    if has.any():
        at = starts[has]
        q = np.clip(1.0 - p, 1e-12, 1.0)
        none = np.exp(np.add.reduceat(np.log(q), at))
        one = none * np.add.reduceat((1.0 - q) / q, at)
        total = np.add.reduceat(p, at)
        out[has, 1] = 1.0 - none
        out[has, 2] = np.clip(1.0 - none - one, 0.0, 1.0)
        out[has, 3] = np.log1p(total)
        out[has, 4] = np.sqrt(total / sizes[has])
    return out


def _chain(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, first-token marks, starts and sizes of documents of token evidence."""
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.empty(0, np.int64)
    code = np.fromiter((x for d in docs for x in d), np.int8, int(sizes.sum())).astype(np.int64)
    first = np.zeros(len(code) + 1, bool)
    first[starts[sizes > 0]] = True
    first[-1] = True
    n = len(LEVELS) + 1
    word, prefix = np.divmod(code, n)
    most = np.maximum(word, prefix)
    before, after = np.zeros_like(code), np.zeros_like(code)
    before[1:], after[:-1] = most[:-1], most[1:]
    before[first[:-1]] = 0
    after[first[1:]] = 0
    return np.stack([word, n + prefix, 2 * n + before, 3 * n + after], axis=1), first[:-1], starts, sizes


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * w * (np.arange(len(w)) > 0)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(sample: pd.DataFrame, prior: float, steps: int = 40) -> Model:
    """Fit on rows (text, toxic), of which every second teaches the evidence and the others the CRF and the scores.

    ``prior`` is the share of toxic documents among all labelled ones.
    """
    m = Model()
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    m.document[0] = np.log(prior / (1 - prior))
    if sample.empty or sample["toxic"].nunique() < 2:
        return m
    half = np.zeros(len(sample), bool)
    for y in (0, 1):
        half[np.flatnonzero(sample["toxic"].to_numpy() == y)[::2]] = True
    count = {0: Counter(), 1: Counter()}
    number = {0: 0, 1: 0}
    for y in (1, 0):
        for text in sample.loc[half & (sample["toxic"] == y), "text"]:
            number[y] += 1
            found = {f for w in set(_TOKEN.findall((text or "").lower())) for f in _features(w)}
            # of clean documents only what toxic ones hold is of interest
            count[y].update(found if y else found & count[1].keys())
    for f, k1 in count[1].items():
        k0 = count[0][f]
        if k0 + k1 >= SUPPORT:
            odds = np.log((k1 + 0.5) / (number[1] + 1)) - np.log((k0 + 0.5) / (number[0] + 1))
            level = int(np.searchsorted(LEVELS, odds - CONFIDENCE * np.sqrt(1 / (k1 + 0.5) + 1 / (k0 + 0.5)), "right"))
            if level:
                m.levels[f] = level
    del count
    rest = sample.loc[~half]
    memo = _Levels(m.levels)
    docs = [[memo[w] for w in _TOKEN.findall(t or "")] for t in rest["text"]]
    toxic = rest["toxic"].to_numpy()
    weight = np.where(toxic == 1, prior / max(1, (toxic == 1).sum()), (1 - prior) / max(1, (toxic == 0).sum())) * len(toxic)
    # batches of whole documents, in random order
    order = np.random.default_rng(1).permutation(len(docs))
    sizes = np.array([len(docs[i]) for i in order])
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // TRAIN_TOKENS)) + 1
    batches = [(_chain([docs[i] for i in part]), np.repeat(toxic[part] == 1, [len(docs[i]) for i in part])) for part in np.split(order, cuts)]
    n = len(LEVELS) + 1
    labels = [bad & ((chain[0][:, :2] - (0, n)).max(axis=1, initial=0) >= TOXIC_LEVEL) for chain, bad in batches]
    for k in range(PASSES):
        _ascend(m, [(chain[0], chain[1], y) for (chain, _), y in zip(batches, labels)], steps)
        if k + 1 < PASSES:
            labels = [bad & (forward_backward(chain[0], chain[1], m) >= SPAN_AT) if len(bad) else bad for chain, bad in batches]
    features = np.concatenate([_document_features(forward_backward(c[0], c[1], m) if len(c[0]) else np.empty(0), c[2], c[3]) for c, _ in batches])
    m.document = _logistic(features, toxic[order].astype(float), weight[order])
    return m


def _ascend(m: Model, batches: list, steps: int) -> None:
    """Gradient ascent (Adam) on the likelihood of labelled chains (features, first, label), batch after batch."""
    batches = [b for b in batches if len(b[0])]
    if not batches:
        return
    size, moved, squared = len(m.emission) + 5, 0.0, 0.0
    for k in range(1, steps + 1):
        level, first, label = batches[k % len(batches)]
        p, xi = forward_backward(level, first, m, pairs=True)
        inner = np.flatnonzero(~first)
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[inner - 1].astype(int), label[inner].astype(int)), 1)
        emitted = np.zeros(len(m.emission))
        for column in level.T:
            emitted += np.bincount(column, weights=label - p, minlength=len(m.emission))
        grad = np.concatenate([emitted, (seen - xi).ravel(), [label[first].sum() - p[first].sum()]])
        now = np.concatenate([m.emission, m.transition.ravel(), [m.start]])
        grad = grad - 0.5 * now
        moved, squared = 0.8 * moved + 0.2 * grad, 0.95 * squared + 0.05 * grad**2
        now = now + 0.25 * (moved / (1 - 0.8**k)) / (np.sqrt(squared / (1 - 0.95**k)) + 1e-9)
        m.emission, m.transition, m.start = now[: size - 5], now[size - 5 : -1].reshape(2, 2), float(now[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_chars: int = MAX_CHARS) -> Model:
    """Fit on documents that ``labels`` marks; both are filtered by the caller if some must not teach."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("_toxic"))
    shares = {r["_toxic"]: r["n"] for r in marked.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.col("_id").cast("string"))
    ids = marked.where("_toxic = 1").orderBy(order, "_id").limit(max_toxic).unionByName(marked.where("_toxic = 0").orderBy(order, "_id").limit(max_clean))
    # at most max_toxic + max_clean ids; ids may repeat, so the rows are bounded again
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), "_id").select("_id", "text", F.col("_toxic").alias("toxic"))
    rows = rows.withColumn("_order", F.xxhash64(F.col("_id").cast("string"), "text"))
    rows = rows.where("toxic = 1").orderBy("_order").limit(max_toxic).unionByName(rows.where("toxic = 0").orderBy("_order").limit(max_clean))
    so_far = F.sum(F.length("text")).over(Window.orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sample = rows.withColumn("_sum", so_far).where(F.col("_sum") <= max_chars).toPandas()
    sample = sample.iloc[np.lexsort((sample["text"].map(hash_of), sample["_id"].map(hash_of)))].reset_index(drop=True)
    total = sum(shares.values())
    return train(sample[["text", "toxic"]], shares.get(1, 0) / total if total else 0.0)


def hash_of(x) -> int:
    import zlib

    return zlib.crc32(str(x).encode("utf-8", "surrogatepass"))


def _scored(m: Model, texts: list, memo: _Levels) -> tuple[np.ndarray, list]:
    """Scores of a list of texts and their spans (start, end, marginal), scan by scan."""
    scores, found, docs, held = [], [], [], 0

    def run():
        level, first, starts, sizes = _chain(docs)
        p = forward_backward(level, first, m) if len(level) else np.empty(0)
        scores.append(1 / (1 + np.exp(-np.clip(_document_features(p, starts, sizes) @ m.document, -30, 30))))
        hits = np.flatnonzero(p >= SPAN_AT)
        for a, b, s in zip(np.searchsorted(hits, starts), np.searchsorted(hits, starts + sizes), starts):
            text = texts[len(found)]
            at = {int(i - s): float(p[i]) for i in hits[a:b]}
            # offsets are looked up only where there is something to tell
            found.append([(x.start(), x.end(), at[i]) for i, x in enumerate(_TOKEN.finditer(text)) if i in at] if at else [])

    for t in texts:
        docs.append([memo[w] for w in _TOKEN.findall(t)] if t else [])
        held += len(docs[-1])
        if held >= SCAN:
            run()
            docs, held = [], 0
    run()
    return np.concatenate(scores), found


def spans(m: Model, text: str | None, memo: _Levels | None = None) -> list[tuple[int, int, float]]:
    """(start, end, marginal) of every token whose marginal reaches SPAN_AT; code points, end exclusive."""
    return _scored(m, [text], memo or _Levels(m.levels))[1][0]


def scorer(docs: DataFrame, m: Model):
    """A function from a text column to a struct of score and spans (array of start, end, marginal)."""
    shared = docs.sparkSession.sparkContext.broadcast(m)
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.DoubleType())))])

    @F.pandas_udf(kind)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = _Levels(shared.value.levels)
        try:
            for batch in batches:
                values, found = _scored(shared.value, list(batch), memo)
                yield pd.DataFrame({"score": values, "spans": [[[float(a), float(b), p] for a, b, p in f] for f in found]})
        finally:
            memo.clear()
            give_back()

    return score


def score(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and spans of each row of ``docs``; one pass, no shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), scorer(docs, m)(F.col(text_col)).alias("_t")).select("doc_id", "_t.score", "_t.spans")


def column(docs: DataFrame, m: Model, text: Column) -> Column:
    """The score alone."""
    return scorer(docs, m)(text)["score"]


def offsets(spans: Column) -> Column:
    """The spans as ``start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s[0].cast("long").cast("string"), s[1].cast("long").cast("string"))), ",")
