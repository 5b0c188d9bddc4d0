import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from corvina.llm import neardup, secrets, toxicity

WORDS = ["".join(random.Random(i).choice(("ka", "lo", "mi", "ne", "ru")) for _ in range(1 + i % 4)) + str(i % 7) for i in range(3000)]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_stages_one_after_another(spark, tmp_path):
    docs = {i: text(i, 120) for i in range(300)}
    for i in range(0, 300, 6):  # toxic
        ws = docs[i].split()
        for k in range(5):
            ws[k * 20] = ("vileword", "hatefulness", "scumbag")[k % 3]
        docs[i] = " ".join(ws)
    item = text(9000, 40)
    docs[1000] = text(1, 60) + " " + item
    docs[1001] = docs[7]  # exact copy
    near = docs[13].split()
    near[60] = "changed"
    docs[1002] = " ".join(near)
    docs[1003] = text(77_003, 80) + ' token = "' + "0123456789abcdef" * 3 + '"'
    row = lambda i, t: (i, t, "en", f"src{i % 3}", len(t))
    d = spark.createDataFrame([row(i, t) for i, t in docs.items()] + [(None, None, None, None, None), (2000, "", "en", "src0", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300) if i % 5], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r["text"] for r in at.collect()}
    toxic = {i for i in range(0, 300, 6)}
    assert len(toxic & set(kept["toxicity"])) <= 2 and len(set(docs) - toxic - set(kept["toxicity"])) <= 3
    left = set(kept["near_duplicates"])
    assert 1001 not in left and 1002 not in left and {7, 13} <= left and set(kept["toxicity"]) - left == {1001, 1002, None}  # a null text is an empty one, as 2000 has
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {1000}
    assert set(kept["secrets"]) == set(kept["decontamination"]) and "0123456789abcdef" not in kept["secrets"][1003] and not secrets.find(kept["secrets"][1003])
    mixed = pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    assert mixed.count() > 0 and {"copy", "n_copies"} <= set(mixed.columns)


def test_rows_are_judged_one_by_one(spark, tmp_path):
    """Rows without an id, rows that repeat, and one id with two texts; a column with an inner name."""
    a, b = "uno dos tres cuatro cinco seis", "otra cosa distinta por completo aqui"
    rows = [(1, a, "es"), (None, a, "de"), (None, b, None), (None, b, "x"), (2, b, "y"), (3, a + " siete", "z"), (3, "nada de eso ni de lo otro", "z"), (4, "cuatro", "u"), (4, "cuatro", "v"), (None, None, "n"), (None, "solo sin id", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _pipeline_row_key string")
    out = pipeline.drop_near_duplicates(spark, d, str(tmp_path))
    assert out.columns == d.columns
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect())
    assert got == sorted([("1", a), ("2", b), ("3", a + " siete"), ("3", rows[6][1]), ("4", "cuatro"), ("None", "None"), ("None", "solo sin id")])


def shingled(t):
    ws = (t or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


@pytest.mark.parametrize("block", [2_048, 24])
def test_near_duplicates_equal_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)  # large classes are compared in blocks
    line = text(5000, 12)  # one very common line
    docs = {i: text(i, 30 + i) + (" " + line if i % 2 else "") for i in range(100)}
    for k in range(200):  # copies of 12 texts with more and more changed words: similarities all around the limit
        r = random.Random(7000 + k)
        ws = text(6000 + k % 12, 150 + 40 * (k % 3)).split()
        for _ in range(1 + k % 9):
            ws[r.randrange(len(ws))] = f"new{r.random()}"
        docs[1000 + k] = " ".join(ws[k % 4 :])
    for k in range(150):  # one large group of near copies
        r = random.Random(9000 + k)
        ws = text(6500, 150).split()
        for _ in range(1 + k % 12):
            ws[r.randrange(len(ws))] = f"new{r.random()}"
        docs[3000 + k] = " ".join(ws)
    docs |= {2000: "", 2001: None, 2002: "uno dos", 2003: "Uno  DOS", 2004: docs[5], 2005: " ".join(line.split()[:6]), 2006: " ".join(line.split()[:7])}
    rows = [*docs.items(), (None, docs[7]), (None, None), (5, docs[1000]), (None, text(1, 40))]  # an id again, with another text
    sets = [(i, shingled(t)) for i, t in rows]
    part = list(range(len(sets)))
    at_limit = 0
    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            both, either = len(a & b), len(a | b)
            at_limit += 0.75 * either <= both < 0.85 * either
            if 5 * both >= 4 * either and part[x] != part[y]:
                part = [part[y] if p == part[x] else p for p in part]
    assert at_limit > 100
    ids = [10**9 if i is None else i for i, _ in sets]
    want = sorted(min(i for i, q in zip(ids, part) if p == q) for p in set(part))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["doc_id"] for r in pipeline.drop_near_duplicates(spark, d, str(tmp_path)).collect()]
    assert sorted(10**9 if i is None else i for i in got) == want
    assert pipeline.drop_near_duplicates(spark, d.limit(0), str(tmp_path)).count() == 0


def test_one_python_worker_a_task(spark, tmp_path, monkeypatch):
    """Links come from Python and are contracted in Python: in one stage a task would hold two workers, which stay."""
    plans = []

    def components(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return found(edges)

    found = neardup.components
    monkeypatch.setattr(neardup, "components", components)
    d = spark.createDataFrame([(1, text(1, 30)), (2, text(1, 30) + " otra"), (3, text(2, 30)), (4, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in pipeline.drop_near_duplicates(spark, d, str(tmp_path)).collect()) == [1, 3, 4]
    assert len(plans) == 3 and not any("MapInPandas" in p for p in plans)


def test_scoring_holds_few_tokens(monkeypatch):
    """A worker's arrays for a batch of 500,000 tokens, which several executors' tasks hold at once."""
    held = []
    chain = toxicity.forward_backward
    monkeypatch.setattr(toxicity, "forward_backward", lambda level, first, m: held.append(len(level)) or chain(level, first, m))
    texts = [text(i, 500) for i in range(1000)]
    m = toxicity.Model(levels={f: 5 for f in toxicity._features("kalo")})
    m.document[1:] = 1.0
    scores, spans = toxicity._scored(m, texts, toxicity._Levels(m.levels))
    assert len(scores) == len(spans) == 1000 and sum(held) >= 500_000 and max(held) <= 101_000
    alone = [toxicity._scored(m, [t], toxicity._Levels(m.levels))[0][0] for t in texts[:20]]
    assert max(abs(scores[:20] - alone)) < 1e-12


def test_toxic_threshold_is_that_of_the_query(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([(i, "uno", i / 10) for i in range(10)], "doc_id long, text string, s double")
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(pipeline.toxicity, "fit", lambda *_: None)
    monkeypatch.setattr(pipeline.toxicity, "column", lambda *_: F.col("s"))
    assert sorted(r["doc_id"] for r in pipeline.drop_toxic(spark, d, str(tmp_path)).collect()) == [0, 1, 2]
