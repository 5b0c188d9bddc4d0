"""Class-based n-gram language model with classes from exchange clustering.

Training counts all words. Those that occur ``LEAST`` times or more, at most
the ``KNOWN`` most frequent, are units that are clustered one by one, so their
number grows with the corpus up to what is broadcast; all other words, unseen
ones included, belong to one of ``GROUPS`` units by a hash of their last
characters, so that every word has a class. Bigram counts of units, dealt
out to blocks and merged in two steps, are the statistics of the exchange: in
each round every block's task finds for half of its units the class under
which the log-likelihood of their left and right contexts is highest, given
the class bigrams of the round before; the round with the best likelihood is
kept.

A text's probability is the product over its tokens of P(class | class
before), interpolated with P(class), and P(word | class) with add-1/2
smoothing and one unseen word per class.

Counts of words beyond the ``KNOWN`` most frequent are never broadcast: the
scoring pass emits those words per document, and a join brings the counts.

Defined results: null text is empty text, of which the end is scored; a
training set without rows gives zero counts and uniform classes; repeated
rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import cut

CLASSES, LEAST, GROUPS, KNOWN = 64, 5, 1_024, 250_000
#: Words over so many bytes are never broadcast, only joined.
LONGEST = 64
ROUNDS, BLOCKS = 10, 192
#: Parts of a block's counts that are merged at first, by a hash of the task that counted them.
SALTS = 8
#: Pseudo-count of the class unigram in P(class | class before).
KAPPA = 5.0
#: Distinct words and tokens that a task holds before it passes on what it counted.
HELD_WORDS, HELD_TOKENS = 150_000, 1_000_000
END = b""


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lowered, then the end (the empty string, which no word is)."""
    ws = text.lower().split()
    ws.append(END)
    return ws


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: Counter = Counter()
    for f in frames:
        for t in f["text"]:
            held.update(tokens(t))
            if len(held) > HELD_WORDS:
                yield pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})
                held.clear()
    if held:
        yield pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})


def vocabulary(docs: DataFrame) -> DataFrame:
    """word (binary), n of all training tokens; docs has one binary column, text."""
    return docs.mapInPandas(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(vocab: DataFrame, most: int = KNOWN) -> pd.DataFrame:
    """At most ``most`` words: all with a count from the lowest bound that keeps to it. No sort, no unbounded collect."""
    short = vocab.where(F.length("word") <= LONGEST)
    bucket = F.floor(F.log2("n") * 32).cast("int")
    sizes = short.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("b")).collect()  # under 2,048 rows
    total, lowest = 0, None
    for r in sizes:
        if total + r["n"] > most:
            break
        total, lowest = total + r["n"], r["b"]
    if lowest is None:
        return pd.DataFrame({"word": [], "n": []})
    found = short.where(bucket >= lowest).toPandas()
    found["word"] = found["word"].map(bytes)
    return found.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


class Words:
    """Units of words: place in the frequent list, or a group by the last characters."""

    def __init__(self, words: list[bytes], counts: np.ndarray, units: int, groups: int):
        self.rank = {w: i for i, w in enumerate(words)}
        self.counts, self.units, self.groups = counts, min(units, len(words)), groups

    def unit(self, word: bytes) -> int:
        i = self.rank.get(word, self.units)
        return i if i < self.units else self.units + zlib.crc32(word.decode("utf-8", "replace")[-2:].encode()) % self.groups


class _Memo(dict):
    def __init__(self, words: Words):
        super().__init__()
        self.words = words

    def __missing__(self, word: bytes) -> int:
        u = self.words.unit(word)
        if len(word) <= LONGEST:
            if len(self) > 400_000:
                self.clear()
            self[word] = u
        return u


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(keys, prepend=0).astype("<i8").tobytes() + counts.astype("<i8").tobytes(), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.decompress(blob), "<i8")
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)


def _place(unit: np.ndarray, width: int) -> np.ndarray:
    """Units in the order of their blocks: each block has every BLOCKS-th unit, so frequent ones are spread."""
    return unit % BLOCKS * width + unit // BLOCKS


def contexts(docs: DataFrame, shared, total_units: int) -> DataFrame:
    """block, right, left: for the units of a block, packed counts of (unit, next) and (unit, before)."""
    width = -(-total_units // BLOCKS)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Memo(Words(*shared.value))
        held: list[np.ndarray] = []
        size, salt = 0, TaskContext.get().partitionId() % SALTS

        def out() -> pd.DataFrame:
            a = np.concatenate([x[:-1] for x in held])
            b = np.concatenate([x[1:] for x in held])
            rows = []
            for kind, key in (("right", _place(a, width) * total_units + b), ("left", _place(b, width) * total_units + a)):
                keys, counts = np.unique(key, return_counts=True)
                block = keys // total_units // width  # units are dealt out to blocks in turn
                cuts = np.flatnonzero(np.diff(block)) + 1
                for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
                    rows.append((int(block[s]), salt, kind, _pack(keys[s:e], counts[s:e])))
            return pd.DataFrame(rows, columns=["block", "salt", "kind", "blob"])

        for f in frames:
            for t in f["text"]:
                ws = tokens(t)
                # the end comes before the first word
                ids = np.empty(len(ws) + 1, np.int64)
                ids[0] = memo[END]
                ids[1:] = [memo[w] for w in ws]
                held.append(ids)
                size += len(ids)
                if size > HELD_TOKENS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, parts, size = None, [], 0

        def packed():
            return pd.DataFrame([(own[0], own[1], _pack(*_merged(parts)))], columns=["block", "kind", "blob"])

        for f in frames:
            for block, kind, blob in f[["block", "kind", "blob"]].itertuples(index=False):
                if own is not None and own != (block, kind):
                    yield packed()
                    parts, size = [], 0
                own = (block, kind)
                parts.append(_unpack(bytes(blob)))
                size += len(parts[-1][0])
                if size > 4_000_000:  # a block can hold at most its units times all units
                    parts = [_merged(parts)]
                    size = len(parts[0][0]) // 2
        if own is not None:
            yield packed()

    once = docs.mapInPandas(count, "block int, salt int, kind string, blob binary")
    once = once.repartition("block", "salt").sortWithinPartitions("block", "kind").mapInPandas(merge, "block int, kind string, blob binary")
    merged = once.repartition("block").sortWithinPartitions("block", "kind").mapInPandas(merge, "block int, kind string, blob binary")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("blob"))).alias(kind)
    return merged.groupBy("block").agg(of("right"), of("left"))


def _sum_by_class(packed: bytes | None, total_units: int, low: int, number: int, classes: np.ndarray, n_classes: int) -> np.ndarray:
    if packed is None:
        return np.zeros((number, n_classes))
    keys, counts = _unpack(bytes(packed))
    u, v = keys // total_units - low, classes[keys % total_units]
    return np.bincount(u * n_classes + v, weights=counts, minlength=number * n_classes).reshape(-1, n_classes)


def _likelihood(n: np.ndarray) -> float:
    """Of the training text, up to a constant: class bigrams less the class unigrams of both places."""
    xlogx = lambda x: float((x * np.log(np.maximum(x, 1e-300))).sum())
    return xlogx(n) - xlogx(n.sum(axis=0)) - xlogx(n.sum(axis=1))


def exchange(stats: DataFrame, total_units: int, n_classes: int, rounds: int, fixed: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit and class bigram counts; unit ``fixed`` (the end) keeps a class of its own."""
    sc = stats.sparkSession.sparkContext
    width = -(-total_units // BLOCKS)
    free = n_classes - 1
    classes = np.arange(total_units) % max(1, free)
    if fixed >= 0:
        classes[fixed] = n_classes - 1
    best = (-np.inf, classes, np.ones((n_classes, n_classes)))
    bigrams = None
    for k in range(rounds + 1):
        now = sc.broadcast((classes, bigrams))

        def move(frames: Iterator[pd.DataFrame], k=k, now=now) -> Iterator[pd.DataFrame]:
            classes, n = now.value
            for f in frames:
                for block, right, left in f.itertuples(index=False):
                    units = np.arange(block, total_units, BLOCKS)
                    r = _sum_by_class(right, total_units, block * width, len(units), classes, n_classes)
                    own = classes[units]
                    pairs = np.zeros((n_classes, n_classes))
                    np.add.at(pairs, own, r)
                    new = own
                    if n is not None:
                        le = _sum_by_class(left, total_units, block * width, len(units), classes, n_classes)
                        m = n + 0.1
                        into = np.log(m / m.sum(axis=1, keepdims=True))  # [before, class]
                        score = le @ (into - np.log(m.sum(axis=0))) + r @ into.T
                        score[:, free:] = -np.inf
                        moves = ((units * 2654435761 >> 7) + k) % 2 == 0
                        moves &= units != fixed
                        new = np.where(moves, score.argmax(axis=1), own)
                    yield pd.DataFrame({"block": [block], "classes": [new.astype("<i2").tobytes()], "pairs": [pairs.tobytes()]})

        rows = stats.mapInPandas(move, "block int, classes binary, pairs binary").collect()  # BLOCKS rows of bounded size
        counted = sum((np.frombuffer(bytes(r["pairs"])).reshape(n_classes, n_classes) for r in rows), np.zeros((n_classes, n_classes)))
        value = _likelihood(counted)
        if value > best[0]:
            best = (value, classes, counted)
        if bigrams is None and k == 0:
            bigrams = counted
            continue
        classes, bigrams = classes.copy(), counted
        for r in rows:
            classes[r["block"] :: BLOCKS] = np.frombuffer(bytes(r["classes"]), "<i2")
    return best[1], best[2]


def score(
    docs: DataFrame,
    trains: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_classes: int = CLASSES,
    units: int = KNOWN,
    groups: int = GROUPS,
    known: int = KNOWN,
    rounds: int = ROUNDS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row; rows with ``trains`` teach."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    spark = docs.sparkSession
    training = docs.where(trains).select(text.alias("text"))
    vocab = cut(vocabulary(training))
    totals = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = totals["n"], totals["v"]
    top = frequent(vocab, known)
    units = min(units, int((top["n"] >= LEAST).sum()))
    words = (top["word"].tolist(), top["n"].to_numpy(np.int64), units, groups)
    shared = spark.sparkContext.broadcast(words)
    total_units = min(units, len(top)) + groups
    stats = cut(contexts(training, shared, total_units))
    end = next((i for i, w in enumerate(words[0][:units]) if w == END), -1)
    classes, bigrams = exchange(stats, total_units, n_classes, rounds, end)

    # tokens and distinct words of each unit, hence of each class
    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Words(*shared.value)
        n, v = np.zeros(total_units, np.int64), np.zeros(total_units, np.int64)
        for f in frames:
            u = np.array([own.unit(bytes(w)) for w in f["word"]], np.int64)
            np.add.at(n, u, f["n"].to_numpy())
            np.add.at(v, u, 1)
        at = np.flatnonzero(v)
        yield pd.DataFrame({"unit": at, "n": n[at], "v": v[at]})

    by_unit = vocab.mapInPandas(sizes, "unit long, n long, v long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()  # total_units rows at most
    n_class = np.bincount(classes[by_unit["unit"]], weights=by_unit["n"], minlength=n_classes)
    v_class = np.bincount(classes[by_unit["unit"]], weights=by_unit["v"], minlength=n_classes)
    unigram = (n_class + 0.5) / (n_class + 0.5).sum()
    transition = np.log10((bigrams + KAPPA * unigram) / (bigrams.sum(axis=1, keepdims=True) + KAPPA))
    below = np.log10(n_class + 0.5 * (v_class + 1))
    below_all = float(np.log10(n_all + 0.5 * (v_all + 1)))
    model = spark.sparkContext.broadcast((classes.astype(np.int16), transition, below))

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Words(*shared.value)
        memo, rank, counts = _Memo(own), own.rank, own.counts
        classes, transition, below = model.value
        logs = np.log10(counts + 0.5)
        last = int(classes[memo[END]])
        for f in frames:
            heads, tails = [], []
            for i, key, t in zip(f["doc_id"], f["key"], f["text"]):
                ws = tokens(t)
                c = classes[[memo[w] for w in ws]]
                before = np.concatenate([[last], c[:-1]])
                ranks = [rank.get(w, -1) for w in ws]
                r = np.array(ranks)
                here = float(logs[r[r >= 0]].sum()) if len(logs) else 0.0
                heads.append((i, key, b"\0" + key.to_bytes(8, "big", signed=True), 1, len(ws), int((r >= 0).sum()), here, float((transition[before, c] - below[c]).sum())))
                if (r < 0).any():
                    tails += [(i, key, w, k, 0, 0, 0.0, 0.0) for w, k in Counter(w for w, x in zip(ws, ranks) if x < 0).items()]
                if len(tails) > 100_000:
                    yield pd.DataFrame(tails, columns=columns)
                    tails = []
            yield pd.DataFrame(heads + tails, columns=columns)

    columns = ["doc_id", "key", "word", "times", "n_tokens", "n_here", "here", "moves"]
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    rows = rows.mapInPandas(local, f"doc_id {id_type}, key long, word binary, times long, n_tokens long, n_here long, here double, moves double")
    # words of few occurrences each, so no key is hot; a head's word is its own
    rows = rows.join(vocab, "word", "left")
    is_tail = F.col("n_tokens") == 0
    known_times = F.when(is_tail & F.col("n").isNotNull(), F.col("times")).otherwise(F.col("n_here"))
    one = rows.groupBy("doc_id", "key").agg(
        F.sum(F.when(is_tail, 0).otherwise(1)).alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(known_times).alias("n_known"),
        F.sum(F.when(is_tail, F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).otherwise(F.col("here"))).alias("counts"),
        F.sum("moves").alias("moves"),
    )
    one = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    each = lambda c: F.col(c) / F.col("copies")
    out = one.select(
        "doc_id",
        each("n_tokens").cast("long").alias("n_tokens"),
        each("n_known").cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (each("counts") - each("n_tokens") * F.lit(below_all)).alias("base_score"),
        (each("counts") + each("moves")).alias("score"),
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
