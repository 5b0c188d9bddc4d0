"""Operators against brute force, round trips and held-out accuracy, on small fixtures."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from corvina.llm import brown, components, crosspolytope, kneser, latent, mixing, queries, secrets, simhash, tagpath, toxicity, wordpiece

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, word string"


def vocab(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice(("ka", "lo", "mi", "ne", "ru", "sta", "po", "vi")) for _ in range(r.randint(1, 4))) for _ in range(n)]


def prose(seed, n, words=None):
    r = random.Random(seed)
    words = words or vocab(0)
    return " ".join(r.choice(words) + ("." if r.random() < 0.1 else "") for _ in range(n))


def odd_rows():
    """Nulls in any column, empty and very long texts, repeated rows, ids that are null; columns named as inner ones."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, prose(1, 60), "en", "a"), (1, prose(1, 60), "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "solo uno", "es", "b"), (4, long, "fr", "a"), (5, "   \n\t ", "de", "c"), (6, prose(2, 80), "en", "a")]
    return [(i, t, g, s, len(t) if t else None, "x", None) for i, t, g, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- secret scans


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def github(body="A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"):
    return "ghp_" + body + secrets.base62(zlib.crc32(body.encode()), 6)


SECRETS = [
    'TOKEN = "' + "0a" * 20 + '" é ſecret: abcdefgh1',
    "password=short password: longenough1 my_api_key='A.B-C_D=E' apikey = \"12345678",
    "AKIAABCDEFGHIJKL AKIAABC aAKIA0123456789ABCD " + "f" * 31 + " " + "e" * 64,
    "token:token:token=abcdefgh secret=" + "Z" * 5000,
    "x " + github() + " " + github()[:-1] + "0",
    "İstanbul password: 12345678",
    None,
    "",
]


@pytest.mark.parametrize("text", SECRETS)
def test_base_spans_stay(text):
    got = [(k, a, b) for a, k, b in secrets.find(text)]
    assert [s for s in got if s[0] in secrets.BASE] == base_spans(text)


def test_checksums_decide():
    t = SECRETS[4]
    assert [k for _, k, _ in secrets.find(t)] == ["github"]
    assert secrets.redact(t).count("[github]") == 1 and secrets.redact("clean") == "clean" and secrets.redact(None) is None


def test_secret_columns(spark):
    d = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id int, text string")
    for r in secrets.scan_documents(d).collect():
        want = base_spans(SECRETS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert r["n_assign"] == sum(k == "assign" for k, _, _ in want)


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    part = "eyJhIjoxfQ"  # {"a":1}
    n = 1_000_000
    assert secrets.find("eyJ" * n) == [] and secrets.find("eyJ" * n + "." + "eyJ" * n) == []
    t = "eyJ" * n + "." + part + "." + part + ".sig"
    assert [(k, a) for a, k, _ in secrets.find(t)] == [("jwt", 3 * n + 1)]
    assert [k for _, k, _ in secrets.find("eyJx" + "-----BEGIN " * 100_000 + "eyJ." * 100_000 + part + "." + part + ".s")] == ["jwt"]
    assert [k for _, k, _ in secrets.find("-----BEGIN PRIVATE KEY-----" + "A" * 300_000 + "-----BEGIN PRIVATE KEY-----" * 20_000)] == []
    assert time.perf_counter() - began < 4


def test_tokens_within_a_run():
    part = "eyJhIjoxfQ"
    for t, want in ((f"x{part}.{part}.s", [1]), (f"eyJ.{part}.{part}.{part}.s", [4]), (f"eyJ_{part}.{part}.s", []), (f"eyJx.{part}.{part}.s {part}.{part}.s", [5, 29])):
        assert [a for a, k, _ in secrets.find(t) if k == "jwt"] == want, t


def test_odd_documents_in_secrets(spark, odd, empty):
    got = secrets.scan_documents(odd.withColumn("spans", F.lit("x"))).collect()
    assert len(got) == 8 and all(r["spans"] == [] for r in got) and secrets.scan_documents(empty).count() == 0


# ---- token counts


def greedy(word, first, rest):
    n, at = 0, 0
    while at < len(word):
        pieces = rest if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        n, at = n + 1, end
    return n


def test_automaton_equals_greedy():
    r = random.Random(3)
    for _ in range(60):
        make = lambda: {"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 12))}
        first, rest = make(), make()
        a = wordpiece.Automaton(sorted(first), sorted(rest))
        for _ in range(60):
            w = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
            assert a.count(w) == greedy(w, first, rest), (w, first, rest)


def greedy_with_bytes(word, pieces):
    """Longest match over the mark and the word; a character without a piece is its bytes."""
    word, at, n = "▁" + word, 0, 0
    while at < len(word):
        # the mark belongs to the first piece only
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces and (at == 0 or word[at] != "▁")), None)
        n += 1 if end else len(word[at].encode())
        at = end or at + 1
    return n


def test_bare_mark_and_bytes():
    a = wordpiece.Automaton(["", "ab"], ["a", "b", "cd"])
    assert [a.count(w) for w in ("ab", "ba", "acd", "cd", "c", "abc")] == [1, 3, 3, 2, 0, 0]
    a = wordpiece.Automaton(["ab"], ["b", "cdñ"], True)
    assert [a.count(w) for w in ("ab", "b", "cdb", "abñ", "中", "abcdñ")] == [1, 4, 6, 3, 6, 2]
    r = random.Random(5)
    for _ in range(60):
        make = lambda: {"".join(r.choice("abñ") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 12))}
        first, rest = make() | ({""} if r.random() < 0.5 else set()), make()
        a, pieces = wordpiece.Automaton(sorted(first), sorted(rest), True), {"▁" + p for p in first} | rest
        for _ in range(60):
            w = "".join(r.choice("abñ中") for _ in range(r.randint(1, 12)))
            assert a.count(w) == greedy_with_bytes(w, pieces), (w, first, rest)


def test_real_vocabulary_equals_greedy():
    path, table = Path("/opt/tokenizers/piece_bpe_32k.model"), Path("/root/testdata/sf0.001/documents.parquet")
    if not path.exists():
        pytest.skip("no vocabulary here")
    first, rest, byte_pieces = wordpiece.sentencepiece_vocabulary(str(path))
    assert "" in first and byte_pieces
    a, pieces = wordpiece.Automaton(first, rest, byte_pieces), {"▁" + p for p in first} | set(rest)
    words = {"ñción", "ñado", "ça", "ßen", "êtes", "中文字", "𓂀x", "\x00", "a▁b", "don't", "Donaudampfschiff"}
    if table.exists():
        words |= {w for t in pd.read_parquet(table)["text"].dropna() for w in t.split() if len(w) < 200}
    for w in words:
        assert a.count(w) == greedy_with_bytes(w, pieces) > 0, w


def test_token_counts(odd):
    got = wordpiece.token_counts(odd, (["w", "ka", "solo"], [*"0123456789", "lo"])).collect()
    assert len(got) == 8
    by = {r["doc_id"]: r for r in got}
    assert by[4]["n_words"] == 30_000 and by[4]["n_unknown"] == 0 and by[2]["n_tokens"] == by[3]["n_tokens"] == by[5]["n_tokens"] == 0
    assert by[None]["n_words"] == 2 and by[None]["n_unknown"] == 1


# ---- nearest neighbours


def brute(ids, x, q, k):
    s = (x * x[q]).sum(axis=1)
    return [int(ids[i]) for i in sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-s[i], ids[i]))[:k]]


def test_neighbours_recall_and_ties(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((600, 16))
    x[300:450] = x[0]  # one very common vector
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(900, None), (920, [0.0] * 16), (940, [None] + [1.0] * 15), (960, [float("nan")] * 16), (980, [1.0] * 3), (0, rows[0][1])]
    d = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {}
    for row in crosspolytope.nearest(d, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["vec_id"])
    ids = np.arange(600)
    assert set(got) == set(range(0, 600, 20)) and all(len(v) == 20 for v in got.values())
    want = {q: brute(ids, x, q, 20) for q in got}
    assert sum(len(set(got[q]) & set(want[q])) for q in got) / (20 * len(got)) >= 0.9
    assert got[0] == want[0] and got[300] == want[300]


def test_ids_with_several_vectors(spark):
    """An id is as near as its nearest vector, and listed once; other columns may have inner names."""
    r = np.random.default_rng(5)
    x = r.standard_normal((200, 8)) * r.uniform(0.5, 2, (200, 1))  # of unequal length
    ids = np.r_[np.arange(150), np.arange(50)]
    x[160] = x[33]
    d = spark.createDataFrame([(int(i), [float(c) for c in v], 1, 2) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, node int, query int")
    got = {}
    for row in crosspolytope.nearest(d, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    assert set(got) == set(range(0, 150, 20))
    hits = 0
    for q, found in got.items():
        best = {}
        for i, v in zip(ids, x):
            if i != q:
                best[int(i)] = max([best.get(int(i), -np.inf), *((x[j] * v).sum() for j in np.flatnonzero(ids == q))])
        want = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:5]
        assert len({i for i, _ in found}) == 5 and all(best[i] == s for i, s in found) and found == sorted(found, key=lambda e: (-e[1], e[0]))
        hits += len(set(found) & set(want))
    assert hits >= 0.9 * 5 * len(got)


def test_probes_come_best_first():
    r = np.random.default_rng(1)
    for bits in (1, 4, 7, 9, 15):
        h = crosspolytope.Hashes(30, 1.0, True, 2, bits, 3)
        d = h.directions(r.standard_normal((5, 30)), True)
        p = h.probes(d, 1).reshape(5, 2)
        assert (p == h.buckets(d)).all()
        most = h.probes(d, 40).reshape(5, 2, -1)
        assert all(len(set(q)) == len(q) == min(40, 1 << bits) for row in most for q in row) and (most[:, :, 0] == p).all()
        if bits == 9:  # against all buckets
            gaps = []
            for j in range(len(h.axes)):
                y = h._transformed(d, 0, j)
                y = np.stack([-y, y], axis=2).reshape(5, -1)
                gaps.append((y.max(axis=1, keepdims=True) - y) ** 2)
            every = (gaps[0][:, :, None] + gaps[1][:, None, :]).reshape(5, -1)
            for i in range(5):
                assert np.allclose(np.sort(every[i])[:40], every[i][most[i, 0]])


def test_few_vectors(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in crosspolytope.nearest(d, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert crosspolytope.nearest(d.limit(0), F.lit(True)).count() == 0


# ---- SimHash


def fingerprint(t):
    ws = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    if not ws:
        return 0
    sh = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [b" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def smallest_reachable(prints, radius):
    """ids -> smallest id over links."""
    ids, comp = list(prints), {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= radius and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp


def test_simhash_classes(spark):
    base = prose(5, 400).split()
    texts = {0: "", 1: None, 2: "uno dos", 3: prose(6, 90), 4: " ".join(base)}
    for k in range(10, 40):  # copies with one word changed, again and again
        base = list(base)
        base[(k * 37) % len(base)] = f"new{k}"
        texts[k] = " ".join(base)
    texts[50] = texts[3]
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.classes(d).collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == smallest_reachable(prints, 3)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    r = random.Random(1)
    fps = {i: (r.getrandbits(5) << 3 | r.getrandbits(2)) for i in range(200)}  # all share most bits
    fps = {i: p for p, i in {p: i for i, p in reversed(fps.items())}.items()}
    nodes = spark.createDataFrame([(i, p.to_bytes(8, "big")) for i, p in fps.items()], "rep long, fp binary")
    e = simhash.edges(nodes, 1, 1, simhash.block_tables(64, 3, 1))
    got = {i: i for i in fps} | {x["node"]: x["component"] for x in components.components(e).collect()}
    assert got == smallest_reachable(fps, 1)


def test_odd_documents_in_simhash(odd, empty):
    got = simhash.classes(odd).collect()
    assert len(got) == 8 and simhash.classes(empty).count() == 0
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 3, 5)} == {2}


def test_null_and_repeated_ids_keep_links(spark):
    """Links over a row without an id hold; two texts of one id don't join their classes."""
    a, b, c = "uno dos tres", "cuatro cinco seis siete", "otro mas"
    prints = {t: fingerprint(t) for t in (a, b, c)}
    rows = [(3, a), (None, a), (7, b), (3, b), (None, c), (None, c), (9, None), (9, a)]
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] != 9)
    h = {t: f"{p:016x}" for t, p in prints.items()}
    assert got == sorted([("3", h[a], 3), ("None", h[a], 3), ("7", h[b], 3), ("3", h[b], 3), ("None", h[c], None), ("None", h[c], None)])
    # a chain whose middle has no id: x - y - z, with x and z more than 3 bits apart
    fps = [(1, 0b0), (None, 0b111), (5, 0b111111), (5, 0b111111 << 40), (8, 0b11111 << 40)]
    original = simhash.fingerprints
    try:
        simhash.fingerprints = lambda text, *_: text.cast("binary")
        raw = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in fps], "doc_id long, text binary")
        got = sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.classes(raw).collect())
    finally:
        simhash.fingerprints = original
    assert got == [("1", 1), ("5", 1), ("5", 5), ("8", 5), ("None", 1)]


def test_nearest_forest_is_minimal():
    r = np.random.default_rng(3)
    pivots = r.integers(0, 2**64, (8, 1), dtype=np.uint64)
    for n in (2, 9, 40):
        fps = r.integers(0, 1 << 12, (n, 1), dtype=np.uint64)
        a, b = simhash.nearest(fps, np.arange(n), 4, pivots)
        distance = np.bitwise_count(fps ^ fps.T)
        every = sorted((int(distance[i, j]), i, j) for i in range(n) for j in range(i) if distance[i, j] <= 4)
        part, want = list(range(n)), 0
        for w, i, j in every:
            if part[i] != part[j]:
                part, want = [part[j] if p == part[i] else p for p in part], want + w
        assert sum(int(distance[i, j]) for i, j in zip(a, b)) == want and len(a) == n - len(set(part))


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 5), (9, 9)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(e).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and got[7] == 5 and 9 not in got


# ---- toxicity


def test_forward_backward_equals_enumeration():
    from itertools import product

    m = toxicity.Model(emission=np.array([-1.0, 0.5, 2.0, 0, 0, 0, 0]), transition=np.array([[0.3, -0.7], [-0.2, 0.9]]), start=-0.4)
    level, sizes = np.array([0, 2, 1, 1, 2, 0, 1]), [4, 1, 2]
    first = np.zeros(7, bool)
    first[[0, 4, 5]] = True
    got = toxicity.forward_backward(level, first, m)
    at = 0
    for n in sizes:
        total, one = 0.0, np.zeros(n)
        for ys in product((0, 1), repeat=n):
            s = m.start * ys[0] + sum(m.emission[level[at + i]] * y for i, y in enumerate(ys)) + sum(m.transition[a, b] for a, b in zip(ys, ys[1:]))
            total += math.exp(s)
            one += np.array(ys) * math.exp(s)
        assert np.allclose(got[at : at + n], one / total)
        at += n


def test_toxicity_held_out(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        ws, bad = prose(i, 60).split(), i % 4 == 0
        for _ in range(4 if bad else 0):
            ws[r.randrange(60)] = r.choice(("Vilword", "nastyling", "nastyest"))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    m = toxicity.fit(d.where("doc_id < 400"), y)
    got = {x["doc_id"]: x for x in toxicity.score(d, m).collect()}
    wrong = [i for i, t in labels if i >= 400 and (got[i]["score"] >= 0.3) != bool(t)]
    assert len(wrong) <= 4
    bad = next(i for i, t in labels if t and i >= 400)
    assert all(rows[bad][1][int(a) : int(b)].lower() in ("vilword", "nastyling", "nastyest") for a, b, _ in got[bad]["spans"]) and got[bad]["spans"]


def test_held_out_labels_do_not_teach(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, prose(i, 9)) for i in range(80)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: seen.extend({r["doc_id"] for r in x.collect()} for x in (docs, labels)))
    nothing = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<array<double>>").alias("spans"))
    monkeypatch.setattr(toxicity, "scorer", lambda *_: lambda text: nothing)
    held = {r["doc_id"] for r in queries.op4_toxicity(spark, str(tmp_path)).where("held_out").collect()}
    assert held and seen[0] == seen[1] == set(range(80)) - held


def test_odd_documents_in_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, labels)).where("score between 0 and 1").count() == 8
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


# ---- language models


def test_class_model(spark):
    rows = [(i, prose(i, 50)) for i in range(80)] + [(80, None), (81, ""), (82, "neverseen word")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in brown.score(d, F.col("doc_id") < 60, n_classes=8, units=100, groups=16, known=150, rounds=3).collect()}
    c = Counter(w for i, t in rows if i < 60 for w in [*t.lower().split(), ""])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        ws = [*(t or "").lower().split(), ""]
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert abs(got[i]["base_score"] - want) < 1e-6 and got[i]["n_tokens"] == len(ws) and got[i]["n_known"] == sum(c[w] > 0 for w in ws) and got[i]["train_tokens"] == n
        assert got[i]["score"] < 0


def test_class_score_equals_brute_force(spark, monkeypatch):
    rows = [(i, prose(i, 40, vocab(0, 300)), i) for i in range(60)] + [(80, None, 0), (81, "", 0), (82, "neverseen word", 0), (5, prose(5, 40, vocab(0, 300)), 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, word int")
    seen, own = [], brown.exchange

    def exchange(stats, total_units, *more):
        seen.append((total_units, *own(stats, total_units, *more)))
        return seen[-1][1:]

    monkeypatch.setattr(brown, "exchange", exchange)
    got = {r["doc_id"]: r["score"] for r in brown.score(d, F.col("doc_id") < 40, n_classes=6, groups=16, known=200, rounds=3).collect()}
    total, classes, bigrams = seen[0]
    train = [[*(t or "").lower().split(), ""] for i, t, _ in rows if i < 40]
    c = Counter(w for ws in train for w in ws)
    top = sorted(c, key=lambda w: (-c[w], w.encode()))
    levels = Counter(int(math.floor(math.log2(c[w]) * 32)) for w in top)
    kept, lowest = 0, None
    for b in sorted(levels, reverse=True):
        if kept + levels[b] > 200:
            break
        kept, lowest = kept + levels[b], b
    units = [w for w in top if math.floor(math.log2(c[w]) * 32) >= lowest and c[w] >= brown.LEAST]
    assert total == len(units) + 16 and len(units) > 20
    place = {w: i for i, w in enumerate(units)}
    of = lambda w: int(classes[place[w] if w in place else len(units) + zlib.crc32(w[-2:].encode()) % 16])
    pairs = np.zeros((6, 6))
    for ws in train:
        for x, y in zip(["", *ws], ws):
            pairs[of(x), of(y)] += 1
    assert (pairs == bigrams).all()
    n, v = np.zeros(6), np.zeros(6)
    for w, k in c.items():
        n[of(w)] += k
        v[of(w)] += 1
    one = (n + 0.5) / (n + 0.5).sum()
    for i, t, _ in rows:
        want, before = 0.0, of("")
        for w in [*(t or "").lower().split(), ""]:
            k = of(w)
            want += math.log10((pairs[before, k] + brown.KAPPA * one[k]) / (pairs[before].sum() + brown.KAPPA)) + math.log10((c[w] + 0.5) / (n[k] + 0.5 * (v[k] + 1)))
            before = k
        assert abs(got[i] - want) < 1e-6, i


def test_class_model_odd(odd, empty):
    assert brown.score(odd, F.lit(True), units=50, groups=8, rounds=1).count() == 8
    assert brown.score(odd, F.lit(False), units=50, groups=8, rounds=1).count() == 8
    assert brown.score(empty, F.lit(True), units=50, groups=8, rounds=1).count() == 0


def test_kneser_ney_equals_brute_force(spark):
    rows = [(i, prose(i, 40, vocab(0, 60)), "en") for i in range(60)] + [(90, None, None), (91, "unknownword ###", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i, "train") for i in range(40)], "_id long, _role string")
    got = {r["doc_id"]: r for r in kneser.perplexities(d, trusted, known=1000).collect()}
    one = Counter(w for i in range(40) for w in kneser.tokens(rows[i][1]))
    index = {w: k + 2 for k, w in enumerate(w for w, k in one.items() if k > 1)}
    seq = lambda t: [1, *(index.get(w, 0) for w in kneser.tokens(t)), 1]
    big = Counter(p for i in range(40) for p in zip(seq(rows[i][1]), seq(rows[i][1])[1:]))
    size = len(index) + 2
    d2 = kneser.discounts(*(sum(c == k for c in big.values()) for k in (1, 2, 3, 4)))
    cont = Counter(w for _, w in big)
    d1 = kneser.discounts(*(sum(c == k for c in cont.values()) for k in (1, 2, 3, 4)))
    uni = lambda w: (max(cont[w] - d1[min(cont[w], 3)], 0) + sum(d1[min(c, 3)] for c in cont.values()) / size) / sum(cont.values())
    assert abs(sum(uni(w) for w in range(size)) - 1) < 1e-9

    def p(h, w):
        own = {x: c for (a, x), c in big.items() if a == h}
        if not own:
            return uni(w)
        t = sum(own.values())
        return max(own.get(w, 0) - d2[min(own.get(w, 0), 3)], 0) / t + sum(d2[min(c, 3)] for c in own.values()) / t * uni(w)

    for i, t, _ in rows:
        s = seq(t)
        want = sum(math.log10(p(a, b)) - (math.log10(kneser.UNSEEN) if b == 0 else 0) for a, b in zip(s, s[1:]))
        assert abs(got[i]["log10_prob"] - want) < 1e-9 and got[i]["n_tokens"] == len(s) - 2


def test_quality_keeps_clean_text(spark, odd, empty):
    rows = [(i, prose(i, 60), "en") for i in range(200)] + [(1000 + i, "@@ ## " * 40, "en") for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(120)] + [(1000, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r["keep"] for r in kneser.classify(d, labels).collect()}
    assert sum(got[i] for i in range(200)) >= 190 and not any(got[1000 + i] for i in range(5))
    assert kneser.classify(odd, labels).count() == 8 and kneser.classify(odd, labels.limit(0)).where("keep").count() == 8
    assert kneser.classify(empty, labels).count() == 0


def test_all_trusted_rows_take_part(spark, monkeypatch):
    labels = spark.range(200_100).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    trusted = kneser.trusted_ids(labels)
    assert trusted.count() == 200_100
    ids = trusted.select("_id").where("_id % 3 != 0").unionByName(spark.createDataFrame([(-(2**62),), (2**62 + 1,)], "_id long"))
    rows = spark.createDataFrame([(i, str(i)) for i in (-1, 0, 1, 2, 2, 3, 4, 199_999, 200_099, 200_100, None, -(2**62), 2**62, 2**62 + 1)], "_id long, text string")
    want = sorted(map(str, (1, 2, 2, 4, 199_999, 200_099, -(2**62), 2**62 + 1)))
    got = lambda r, i: sorted(x["text"] for x in kneser.having(r, i).collect())
    assert got(rows, ids) == want and got(rows, ids.limit(0)) == []
    as_text = lambda df: df.withColumn("_id", F.col("_id").cast("string"))
    assert got(as_text(rows), as_text(ids)) == want
    monkeypatch.setattr(kneser, "MAX_LISTED", 10)
    assert got(rows, ids) == want


def test_quality_thresholds_are_exact(spark):
    held = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("lang"), F.pow(F.rand(5) * 10, 6).alias("x"))
    held = held.unionByName(spark.createDataFrame([("c", 2.0)] * 60 + [("c", 1.0)] * 40 + [("c", None), ("d", 7.0)], "lang string, x double")).cache()
    values = {}
    for r in held.where("x is not null").collect():
        values.setdefault(r["lang"], []).append(r["x"])
    for q in (0.98, 0.4):
        got = {r["lang"]: r["quantile"] for r in kneser.quantiles(held, "lang", "x", q).collect()}
        assert got == {k: sorted(v)[math.ceil(len(v) * q) - 1] for k, v in values.items()}


def test_ids_beside_null_stay_exact(spark):
    big = 2**53 + 1
    d = spark.createDataFrame([(big, "a b a b", "en"), (None, "a b", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["role"], r["lang"]) for r in kneser.perplexities(d, spark.createDataFrame([(big, "train")], "_id long, _role string")).collect()}
    assert got == {big: ("train", "en"), None: (None, None)}


# ---- decontamination


def test_leaks_and_paraphrases(spark):
    items = {i: prose(1000 + i, 40, vocab(7, 3000)) for i in range(12)}
    r, rows = random.Random(2), []
    for i in range(60):
        rows.append((i, prose(i, 200, vocab(9, 3000))))
    for i in range(12):
        ws = items[i].split()
        if i % 2:  # a paraphrase: every sixth word is another
            ws = [w if k % 6 else r.choice(vocab(9, 3000)) for k, w in enumerate(ws)]
        rows.append((100 + i, prose(500 + i, 60, vocab(9, 3000)) + " " + " ".join(ws).upper() + " " + prose(700 + i, 60, vocab(9, 3000))))
    d = spark.createDataFrame([*rows, (None, items[0]), (300, None), (301, "")], "doc_id long, text string")
    b = spark.createDataFrame([*items.items(), (None, "x y z"), (99, None), (98, "")], "item_id long, text string")
    got = {x["doc_id"]: x for x in latent.decontaminate(d, b).collect()}
    assert all(got[100 + i]["contaminated"] and got[100 + i]["item_id"] == i for i in range(12)) and got[None]["contaminated"]
    assert not any(got[i]["contaminated"] for i in [*range(60), 300, 301])
    assert latent.decontaminate(d, b.limit(0)).where("contaminated").count() == 0
    assert latent.decontaminate(d.limit(0), b).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(latent, "MAX_ITEMS", 2)
    items = {i: prose(1000 + i, 30, vocab(7, 2000)) for i in range(5)}
    d = spark.createDataFrame([(i, items[i]) for i in range(5)] + [(9, prose(3, 90))], "doc_id long, text string")
    got = {x["doc_id"]: (x["contaminated"], x["item_id"]) for x in latent.decontaminate(d, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert all(got[i] == (True, i) for i in range(5)) and not got[9][0]


def test_blocks_of_items_keep_rows(spark, monkeypatch):
    """Null and repeated ids: the same rows as without blocks."""
    items = {i: prose(1000 + i, 30, vocab(7, 2000)) for i in range(5)}
    rows = [(None, items[0]), (None, prose(3, 90)), (None, None), (7, items[1]), (7, items[1]), (7, prose(4, 90)), (8, items[2] + " " + items[3])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = lambda: sorted((str(x["doc_id"]), x["contaminated"], x["n_items"]) for x in latent.decontaminate(d, b).collect())
    whole = found()
    assert whole == [("7", False, 0), ("7", True, 1), ("7", True, 1), ("8", True, 2), ("None", False, 0), ("None", False, 0), ("None", True, 1)]
    monkeypatch.setattr(latent, "MAX_ITEMS", 2)
    assert found() == whole


def test_short_items(spark):
    """Items of few words leak where they stand word by word, very short ones as a whole document only."""
    kanji = "".join(chr(0x4E00 + 7 * i) for i in range(30))
    b = spark.createDataFrame([(1, "Constantinople, Trebizond, Thessalonica"), (2, kanji + "。"), (3, "yes"), (4, "?!"), (5, None)], "item_id long, text string")
    texts = ["from constantinople trebizond thessalonica home", "constantinople thessalonica trebizond", "so " + kanji, kanji[:-1], "Yes!", "yes it is", "", None, "trebizond thessalonica"]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, leaked string")
    got = {r["doc_id"]: r["item_id"] if r["contaminated"] else None for r in latent.decontaminate(d, b).collect()}
    assert got == {0: 1, 1: None, 2: 2, 3: None, 4: 3, 5: None, 6: None, 7: None, 8: None}
    # beside longer ones
    longer = prose(1, 30, vocab(7, 2000))
    got = {r["doc_id"]: (r["contaminated"], r["n_items"]) for r in latent.decontaminate(d.unionByName(spark.createDataFrame([(20, longer + " " + texts[0], "x")], d.schema)), b.unionByName(spark.createDataFrame([(9, longer), (9, longer)], b.schema))).collect()}
    assert got[20] == (True, 2) and got[0] == (True, 1) and got[4] == (True, 1) and not got[5][0]


def test_odd_documents_in_decontamination(odd, spark):
    b = spark.createDataFrame([(1, prose(1, 60)), (1, prose(1, 60)), (2, " ".join(f"w{i % 977}" for i in range(500, 560)))], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["contaminated"], r["n_items"]) for r in latent.decontaminate(odd, b).collect())
    assert got == [("1", True, 1), ("1", True, 1), ("2", False, 0), ("3", False, 0), ("4", True, 1), ("5", False, 0), ("6", False, 0), ("None", False, 0)]


def test_products_and_subsequences():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 300, 20)
    ids = r.integers(0, 50, sizes.sum())
    idf = np.r_[0.0, r.uniform(1, 5, 49)]
    p = latent.Passages(ids, sizes, idf)
    a = np.zeros((len(p.lo), 50))
    for w in range(len(p.lo)):
        for j in range(p.lo[w], p.hi[w]):
            a[w, p.ids[j]] += idf[p.ids[j]] / p.norm[w]
    m = r.standard_normal((50, 7))
    assert np.allclose(p.times(m), a @ m, atol=1e-4) and np.allclose(p.transposed_times(p.times(m), 50), a.T @ (a @ m), atol=1e-3)
    for _ in range(50):
        x, y = r.integers(0, 5, 12).tolist(), r.integers(0, 5, 15).tolist()
        t = [[0] * 16 for _ in range(13)]
        for i in range(12):
            for j in range(15):
                t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i][j + 1], t[i + 1][j])
        masks = {}
        for k, v in enumerate(x):
            masks[v] = masks.get(v, 0) | 1 << k
        assert latent.lcs(masks, 12, y) == t[12][15]


def test_products_do_not_depend_on_other_passages():
    """A passage of small weights beside ones of large weights; documents of all lengths around a cell, empty ones too; groups of many rows."""
    r = np.random.default_rng(1)
    sizes = np.array([0, 1, 2, 15, 16, 17, 0, 31, 32, 33, 48, 49, 400, 0])
    ids = r.integers(0, 9, sizes.sum())
    ids[: sizes[:6].sum()] = 9
    idf = np.r_[0.0, np.ones(9)]
    m = r.standard_normal((10, 5)).astype(np.float32)
    m[9] *= 1e9
    p = latent.Passages(ids, sizes, idf)
    a = np.zeros((len(p.lo), 10))
    for w in range(len(p.lo)):
        np.add.at(a[w], p.ids[p.lo[w] : p.hi[w]], 1 / p.norm[w].astype(float))
    assert np.allclose(p.times(m), a @ m, rtol=1e-4, atol=1e-4)
    y = r.standard_normal((len(p.lo), 5)).astype(np.float32)
    assert np.allclose(p.transposed_times(y, 10), a.T @ y, rtol=1e-4, atol=1e-4)
    parts = np.zeros((10, 5))
    for s in range(0, len(p.lo), 7):
        p.add_transposed(y[s : s + 7], parts, s, s + 7)
        assert np.array_equal(p.times_weighted(m, s, s + 7), p.times_weighted(m)[s : s + 7])
    assert np.allclose(parts, a.T @ y, rtol=1e-4, atol=1e-4)


def test_encoded_words_are_the_words():
    r = random.Random(5)
    signs = "aZ09_ .-\t\n\x1c\x1f\x7f\x85\xa0éÉßİKſµ·'’“¿—ǅΣς日本。٣²½\u0301\u200d\u2028\ud7ff\ufeff😀𝒜"
    texts = ["".join(r.choices(signs, k=40)) for _ in range(500)] + ["".join(map(chr, range(0xD800))), "".join(map(chr, range(128))), "", None]
    assert all([w.decode() for w in latent.encoded_words(t)] == latent.words(t) for t in texts)


# ---- page extraction

PAGES = {
    "<html><head><title>no</title></head><body><nav><a href=x>Menu, one</a></nav><article><h1>Head&amp;line</h1><p><b>First  words,\nhere.<br><p>Second, paragraph: with more.</article><footer>&copy; foot</footer></body></html>": "Head&line First words, here. Second, paragraph: with more.",
    '<body><div class="site-header">Logo</div><div id=content><h2>T</h2><p>Some long text, with commas, and more of it. Yes.</p><p>Ok.</p></div><div class="sidebar"><p>Other, stuff, here.</p></div><div id="comments"><p>I disagree, strongly, with this.</p></div><form>Name, mail</form></body>': "T Some long text, with commas, and more of it. Yes. Ok.",
    "just text": "just text",
    "": "",
    None: "",
    "<p>a<script>var x = '</p>';</script>b</p>": "ab",
    "<!-- only": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert tagpath.main_text(page) == PAGES[page]


LINE = "A line of the article, with commas, and enough of it. "
WHOLE = {
    "list": f"<body><article><h1>Head</h1><p>{LINE * 2}</p><ul>{f'<li>{LINE * 2}</li>' * 10}</ul></article></body>",
    "only the list": f"<body><article><h1>Head</h1><ul>{f'<li>{LINE * 2}</li>' * 10}</ul></article></body>",
    "lead": f"<body><div id=page><p>{LINE * 2}</p><div class=body>{f'<p>{LINE * 3}</p>' * 9}</div></div></body>",
    "sections": f"<body><main><section class=a><p>{LINE * 2}</p></section><section class=b>{f'<p>{LINE * 3}</p>' * 9}</section></main></body>",
    "closing": f"<body><h1>Head</h1>{f'<p>{LINE * 3}</p>' * 5}<h3>So</h3><p>Ok.</p></body>",
    "closing of one part": f"<body><div class=a><p>{LINE * 3}</p></div><div class=b>{f'<p>{LINE * 3}</p>' * 5}<h3>So</h3><div>Ok.</div></div></body>",
    "links": f"<body><article><h1>Head</h1>{f'<p>{LINE * 3}</p>' * 5}<ul><li><a href=x>A source</a></li></ul></article></body>",
    "named title": f'<body><article><div class="entry-header"><h1>Head</h1><p class="byline meta">By A. Writer</p></div>{f"<p>{LINE * 3}</p>" * 5}</article></body>',
    "named part": f'<body><article><h1>Head</h1><section id="search">{f"<p>{LINE * 3}</p>" * 5}</section><section class="side">{f"<p>{LINE * 3}</p>" * 2}</section></article></body>',
    "named part beside the text": f'<body><div class=q><div class="post-header"><h1>Head</h1></div>{f"<p>{LINE * 3}</p>" * 5}</div></body>',
    "named wrapper": f'<body><div class="layout with sidebar"><article><h1>Head</h1>{f"<p>{LINE * 3}</p>" * 5}</article></div></body>',
    "a line that is a link": f"<body><article><h1>Head</h1><p>{LINE * 3}</p><p><a href=x>{LINE}</a></p><p>{LINE * 3}</p></article></body>",
    "title": f"<body><main><h1>Head</h1><article>{f'<p>{LINE * 3}</p>' * 5}</article></main></body>",
}


@pytest.mark.parametrize("name", WHOLE)
def test_main_text_is_whole(name):
    outside = '<nav><a href=x>Menu</a></nav>', "<footer>Foot</footer>"
    page = WHOLE[name].replace("<body>", "<body>" + outside[0]).replace("</body>", outside[1] + "</body>")
    assert tagpath.main_text(page) == " ".join(re.sub("<[^>]*>", " ", WHOLE[name]).split())


def test_menus_beside_the_text_stay_out():
    menu = "<ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul>"
    text = f"<div class=text>{f'<p>{LINE * 3}</p>' * 5}</div>"
    for page in (f"<body>{menu}{text}{menu}</body>", f"<body><div class=page>{menu}{text}{menu}</div></body>"):
        assert tagpath.main_text(page) == " ".join([*(LINE * 15).split()])


def test_formulas_stay():
    assert tagpath.main_text(f"<article><p>{LINE}So <math><mi>x</mi><mo>=</mo><msup><mi>y</mi><mn>2</mn></msup></math>, which holds.</p></article>") == LINE + "So x=y2, which holds."


def test_names_that_tell_nothing():
    """Menus, adverts and footers known by their ratios alone."""
    links = "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(8))
    text = f"<div class=k3><h1>Head</h1>{f'<p>{LINE * 3}</p>' * 6}<h2>More</h2>{f'<p>{LINE * 2}</p>' * 3}</div>"
    page = f"<body><div class=k1><ul>{links}</ul></div><div class=k2>{text}</div><div class=k4><ul>{links}</ul></div><div class=k5><a href=q>Contact</a> 2024 Site</div></body>"
    assert tagpath.main_text(page) == " ".join(["Head", *(LINE * 18).split(), "More", *(LINE * 6).split()])


def test_comments_stay_out():
    thread = "".join(f"<div class=c><p>{LINE * 4}</p></div>" for _ in range(30))
    for name in ('id="comments"', 'class="post-comments"'):
        assert tagpath.main_text(f"<body><article><h1>Head</h1>{f'<p>{LINE * 3}</p>' * 4}<section {name}>{thread}</section></article></body>") == " ".join(["Head", *(LINE * 12).split()])


def test_pages_take_linear_time():
    began = time.perf_counter()
    deep = "<div>" * 100_000
    assert tagpath.main_text(deep + "text") == "text"
    assert tagpath.main_text("<x-a>" * 50_000 + f"<p>{LINE}") == LINE.strip()
    tagpath.main_text("<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "t")
    tagpath.main_text("<a " * 350_000)
    tagpath.main_text("<script" * 100_000 + "</script " * 50_000)
    assert len(tagpath.main_text("<p>" + LINE * 50_000)) == len(LINE) * 50_000 - 1
    assert time.perf_counter() - began < 12


def test_odd_pages(spark):
    d = spark.createDataFrame([(1, "u", "<p>a, b.</p>"), (1, "u", "<p>a, b.</p>"), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in tagpath.extract_pages(d).collect())
    assert got == [("1", "a, b.", 5), ("1", "a, b.", 5), ("2", "", 0), ("None", "", 0)] and tagpath.extract_pages(d.limit(0)).count() == 0


def test_page_columns(spark):
    d = spark.createDataFrame([(1, None, "<p>é, x</p>", "clash"), (None, "u", None, "clash")], "page_id long, url string, html string, text string")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in tagpath.extract_pages(d).collect()) == [("1", "é, x", 4), ("None", "", 0)]


# ---- mixing


def test_poisson_counts(spark, odd, empty):
    d = spark.createDataFrame([(i, f"t{i}", "a" if i % 3 else "b") for i in range(6000)], "doc_id long, text string, source string")
    out = mixing.replicate(d, {"a": 1.0, "b": 3.0})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 1500) < 200 and abs(n["b"] - 4500) < 330
    c = Counter(r["n_copies"] for r in out.where("source = 'a' and copy = 1").collect())
    for k in (1, 2):
        assert abs(c[k] / 4000 - mixing.expected(0.375, k)) < 0.03
    keys = [r["shuffle_key"] for r in out.collect()]
    assert keys == sorted(keys)
    again = mixing.replicate(d.repartition(7), {"a": 1.0, "b": 3.0})
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    assert {r["source"] for r in mixing.replicate(odd, epochs=9.0).collect()} == {"a", "b", "c", None} and mixing.replicate(empty).count() == 0


def test_many_sources(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"t{i}", f"s{i % 5}") for i in range(300)], "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.replicate(d).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.replicate(d).collect())) == want


def test_names_that_clash(spark):
    names = ["_u", "_source", "_rate", "_table", "_salt", "_own_salt", "_range", "_from", "_n", "_cdf"]
    d = spark.createDataFrame([(i, f"t{i}", "a", *names) for i in range(50)], ["doc_id", "text", "source", *names])
    out = mixing.replicate(d, epochs=3.0)
    assert out.columns == [*d.columns, *mixing.ADDED] and 90 < out.count() < 210 and out.where("_rate = '_rate' and _u = '_u'").count() == out.count()
    with pytest.raises(ValueError):
        mixing.replicate(d.withColumn("Rate", F.lit(1)))


@pytest.mark.parametrize("rate", [0.2, 3.0, 150.0, 900.0, 50_000.0])
def test_tables_of_the_distribution(spark, rate):
    t = spark.range(1).select(mixing.poisson_cdf(F.lit(rate)).alias("t")).first()["t"]
    ks = np.arange(0, t["low"] + len(t["cdf"]))
    want = np.cumsum([math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in ks])[t["low"] :]
    assert np.allclose(t["cdf"], want, atol=1e-7) and abs(t["cdf"][-1] - 1) < 1e-7 and t["cdf"][0] < 1e-12 or t["low"] == 0 and np.allclose(t["cdf"], want, atol=1e-9)


def test_rows_of_many_copies(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"t{i}", "a" if i else "b") for i in range(400)], "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.replicate(d, epochs=9.0).collect()))
    rare = [r for r in want if r[2] == "b"]
    assert abs(len(rare) - 1800) < 300 and sorted(r[3] for r in rare) == list(range(1, len(rare) + 1))
    monkeypatch.setattr(mixing, "COPIES", 7)
    assert sorted(map(tuple, mixing.replicate(d, epochs=9.0).collect())) == want
