import json
import struct
import zlib

from pyspark.sql import functions as F

from corvina.operators import cluster, eda, vision
from corvina.sources import feeds, files, paged
from corvina.streaming import streams


def png(path, rows):
    """An RGB file of rows of (r, g, b)."""
    raw = b"".join(b"\0" + bytes(c for p in row for c in p) for row in rows)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_colours_of_an_image(spark, tmp_path):
    png(tmp_path / "a.png", [[(255, 0, 0), (255, 0, 0), (0, 255, 0), (255, 255, 255)]])
    (tmp_path / "broken.png").write_bytes(b"nothing")
    p = vision.pixels(files.images(spark, str(tmp_path)))
    assert p.count() == 4
    r = vision.colour_shares(p).first()
    assert (r["n_pixels"], r["Rojo"], r["Verde"], r["predominant"]) == (3, 2, 1, "Rojo")


def test_messages(spark):
    text = "hola###FIN###resto"
    bits = [int(b) for c in text for b in f"{ord(c):08b}"] + [1, 0, 1]
    grey = spark.createDataFrame([("i", k, 200 + b) for k, b in enumerate(bits)], "image string, pos long, v int")
    assert vision.grey_message(grey).first()["message"] == "hola###FIN###"
    # the same in the value channel of orange pixels, others in between
    rows, k = [], 0
    for b in bits:
        rows += [("i", k, 0, 0, 0), ("i", k + 1, 0, 120, 200 + b)]
        k += 2
    p = spark.createDataFrame(rows, "image string, pos long, b int, g int, r int")
    assert vision.masked_message(p).first()["message"] == "hola###FIN###"


def test_statistics(spark):
    d = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "a"), (3, 3.0, None), (4, 4.0, "b"), (4, 4.0, "b")], "i int, x double, c string")
    r = eda.describe(d, ["x"]).first()
    assert (r["count"], r["mean"], r["q25"], r["q50"], r["q75"]) == (5, 2.8, 2.0, 3.0, 4.0)
    assert eda.duplicate_rows(d).first()["n"] == 1
    assert {x["c"]: x["n"] for x in eda.value_counts(d, "c").collect()} == {"a": 2, "b": 2}
    assert {x["column"]: x["n_null"] for x in eda.null_counts(d).collect()} == {"i": 0, "x": 0, "c": 1}
    assert sum(x["n"] for x in eda.histogram(d, "x", 3).collect()) == 5


def test_clusters_and_svd(spark):
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(0, Vectors.dense(1.0, 0.0, 0.0)), (1, Vectors.dense(0.9, 0.1, 0.0)), (2, Vectors.dense(0.0, 0.0, 1.0))], ["doc_id", "features"])
    got = {r["doc_id"]: r["prediction"] for r in cluster.kmeans(rows, 2, restarts=3).transform(rows).collect()}
    assert got[0] == got[1] != got[2]
    x = {r["doc_id"]: (r["x1"], r["x2"]) for r in cluster.truncated_svd(rows, 2).collect()}
    assert abs(sum(v * v for v in x[0]) - 1) < 0.02 and abs(x[2][0] ** 2 + x[2][1] ** 2 - 1) < 1e-9


def test_csv_and_json_round_trip(spark, tmp_path):
    d = spark.createDataFrame([('a "b", c\nd', 1)], "texto string, n int")
    for bom in (False, True):
        files.write_csv(d, str(tmp_path / f"c{bom}"), bom)
        part = next((tmp_path / f"c{bom}").glob("part*.csv"))
        assert part.read_bytes().startswith(b"\xef\xbb\xbf") == bom
        back = files.csv(spark, str(tmp_path / f"c{bom}"))
        assert [tuple(r) for r in back.collect()] == [('a "b", c\nd', 1)] and back.columns == ["texto", "n"]
    files.write_json(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    (tmp_path / "array.json").write_text(json.dumps([{"a": "ñ"}, {"a": "b"}], indent=2, ensure_ascii=False), encoding="utf-8")
    assert files.json_array(spark, str(tmp_path / "array.json")).count() == 2


def test_text_folder(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("señal\xff".encode("latin-1").replace(b"\xf1", "ñ".encode()))
    (tmp_path / "a.txt").write_text("uno\ndos")
    (tmp_path / "c.md").write_text("no")
    assert [tuple(r) for r in files.text_folder(spark, str(tmp_path)).orderBy("name").collect()] == [("a.txt", "uno\ndos"), ("b.txt", "señal")]


def test_feeds(spark):
    body = "<rss><channel><title>T</title>" + "".join(f"<item><title>n{i}</title><description><![CDATA[<p>d{i}</p>]]></description><pubDate>Sat, 07 Feb 2026 16:44:46 GMT</pubDate></item>" for i in range(5)) + "</channel></rss>"
    f = spark.createDataFrame([("u1", body), ("u2", None)], "url string, body string")
    rows = feeds.with_clean_text(feeds.items(f, 3)).orderBy("pos").collect()
    good = [r for r in rows if r["error"] is None]
    assert [r["title"] for r in good] == ["n0", "n1", "n2"] and good[0]["text_clean"] == "n0 d0" and good[0]["link"] == "" and good[0]["source"] == "T"
    assert [(r["url"], r["text_clean"]) for r in rows if r["error"]] == [("u2", None)]
    assert spark.createDataFrame([("Sat, 07 Feb 2026 16:44:46 GMT",)], "p string").select(feeds.timestamp(F.col("p")).cast("string").alias("t")).first()["t"] == "2026-02-07 16:44:46"


def test_paged_source(spark, tmp_path):
    for o in (0, 100):
        (tmp_path / f"p{o}.json").write_text(json.dumps({"rows": [{"row": {"id": o + i, "text": f"t{o + i}", "TOXICIDAD": "1", "CONST": "no"}} for i in range(100)]}))
    url = f"file://{tmp_path}/p{{offset}}.json"
    assert paged.read(spark, url, 200).count() == 200
    assert paged.read(spark, url, 400).count() == 200  # pages that fail end the read


def test_streams(spark, tmp_path):
    spark.createDataFrame([("<b>Uno</b>",), ("dos!",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    streams.run_available(streams.cleaned(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["text_clean"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["dos", "uno"]


def test_paging_until_enough_rows(spark, tmp_path):
    # pages of 3, 3 and 1 rows, although 4 are asked for
    for o, n in ((0, 3), (3, 3), (6, 1)):
        (tmp_path / f"p{o}.json").write_text(json.dumps({"rows": [{"row": {"id": o + i, "text": f"t{o + i}"}} for i in range(n)]}))
    url = f"file://{tmp_path}/p{{offset}}.json"
    ids = lambda n: sorted(int(r["id"]) for r in paged.read_until(spark, url, n, 4).collect())
    assert ids(5) == list(range(5)) and ids(7) == ids(50) == list(range(7))


def test_decoded_flipped_resized(spark):
    p = spark.createDataFrame([(i, x, y, 10 * x + y) for i in range(20) for x in range(4) for y in range(2)], "image int, x int, y int, v int")
    assert abs(vision.decoded(p, ["v"]).agg(F.max("v")).first()[0] - 31 / 355) < 1e-12
    turned = {(r["image"], r["x"], r["y"]): r["v"] for r in vision.flipped(p, 4, 2, 3).collect()}
    corners = {turned[i, 0, 0] for i in range(20)}
    assert len(turned) == 160 and corners == {0, 1, 30, 31}
    same = vision.resized(p, (4, 2), (4, 2)).join(p.withColumnRenamed("v", "w"), ["image", "x", "y"]).where("abs(v - w) < 1e-9").count()
    assert same == 160
    half = {(r["x"], r["y"]): r["v"] for r in vision.resized(p, (4, 2), (2, 1)).where("image = 0").collect()}
    assert half == {(0, 0): 5.5, (1, 0): 25.5}
    wide = {r["x"]: r["v"] for r in vision.resized(p, (4, 2), (8, 2)).where("image = 0 and y = 0").collect()}
    assert [wide[x] for x in range(8)] == [0, 2.5, 7.5, 12.5, 17.5, 22.5, 27.5, 30]


def test_exact_density(spark):
    import math
    import statistics

    xs = [1.0, 2.0, 2.0, 5.0]
    d = spark.createDataFrame([("a", x) for x in xs] + [("a", None), ("b", 3.0)], "g string, x double")
    got = eda.density(d, "g", "x", 5).orderBy("i").collect()
    h = statistics.stdev(xs) * len(xs) ** -0.2
    want = [sum(math.exp(-0.5 * ((p - x) / h) ** 2) for x in xs) / (len(xs) * h * math.sqrt(2 * math.pi)) for p in (1, 2, 3, 4, 5)]
    assert [r["g"] for r in got] == ["a"] * 5 and all(abs(r["density"] - w) < 1e-12 for r, w in zip(got, want))
