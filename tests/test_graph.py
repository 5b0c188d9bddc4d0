import pytest

from corvina.operators import graph

G = [
    ("ex:alicia", "tipo", "ex:Persona"),
    ("ex:alicia", "nombre", "Alicia García"),
    ("ex:alicia", "conoce", "ex:bob"),
    ("ex:bob", "nombre", "Bob Martínez"),
    ("ex:bob", "tipo", "ex:Persona"),
    ("ex:libro42", "titulo", "Introducción a la Web Semántica"),
    ("ex:libro42", "autor", "ex:alicia"),
    ("ex:libro42", "autor", "ex:bob"),
    ("ex:libro42", "anio", "2019"),
]


@pytest.fixture(scope="module")
def g(spark):
    return graph.graph(spark.createDataFrame(G + G[:2], graph.TRIPLE))


def test_patterns(g):
    assert g.count() == 9
    assert graph.simple_pattern(g, p="autor", o="ex:libro42").count() == 0
    assert sorted(tuple(r) for r in graph.simple_pattern(g, p="nombre").collect()) == [("ex:alicia", "Alicia García"), ("ex:bob", "Bob Martínez")]
    assert graph.simple_pattern(g, "ex:libro42", "anio", "2019").count() == 0


def test_bgp_and_union(g):
    ps = [("ex:libro42", "autor", "?p"), ("?p", "nombre", "?n")]
    for order in (ps, ps[::-1]):
        assert sorted((r["p"], r["n"]) for r in graph.bgp(g, order).collect()) == [("ex:alicia", "Alicia García"), ("ex:bob", "Bob Martínez")]
    both = graph.bgp_with_union(g, [("?p", "nombre", "?n")], [[("?p", "conoce", "?x")], [("?p", "tipo", "?y")]])
    assert sorted(r["p"] for r in both.collect()) == ["ex:alicia", "ex:alicia", "ex:bob"]
    with pytest.raises(ValueError):
        graph.bgp(g, [("?a", "nombre", "?b"), ("?c", "anio", "?d")])


def test_resolution(spark):
    labels = spark.createDataFrame([("http://geo.example/city/paris", "París (ciudad)")], "uri string, label string")
    same = spark.createDataFrame([("París", "http://geo.example/city/paris")], "name string, uri string")
    names = spark.createDataFrame([("París",), ("http://geo.example/city/paris",), ("París Hilton",)], "name string")
    got = {r["name"]: r["resolved"] for r in graph.resolve(names, labels, same).collect()}
    assert got == {"París": "París (ciudad)", "http://geo.example/city/paris": "París (ciudad)", "París Hilton": "París Hilton"}


def test_classes_of_equals(spark):
    pairs = spark.createDataFrame([(str(i), str(i + 1)) for i in range(10, 40)] + [("x", "y")], "a string, b string")
    got = {r["node"]: r["canonical"] for r in graph.same_classes(pairs).collect()}
    assert all(got[str(i)] == "10" for i in range(10, 41)) and got["y"] == "x"


def test_coverage_and_prefixes(g, spark):
    want = spark.createDataFrame([("autor",), ("isbn",)], "p string")
    assert {r["p"]: r["present"] for r in graph.coverage(g, want).collect()} == {"autor": True, "isbn": False}
    assert graph.expand({"ex": "http://e/"}, "ex:a") == "http://e/a" and graph.expand({}, "ex:a") == "ex:a"


def test_optional_and_aggregate(spark):
    from pyspark.sql import functions as F

    from corvina.operators import graph

    g = graph.graph(spark.createDataFrame([("a", "kind", "k1"), ("b", "kind", "k1"), ("c", "kind", "k2"), ("a", "name", "A")], graph.TRIPLE))
    found = graph.optional(graph.bgp(g, [("?x", "kind", "?k")]), g, [("?x", "name", "?n")])
    assert sorted(map(tuple, found.select("x", "k", "n").collect()), key=str) == [("a", "k1", "A"), ("b", "k1", None), ("c", "k2", None)]
    top = graph.aggregate(found, ["k"], having=F.col("n_x") > 1, order=["k"], limit=5, n_x=F.count("x"))
    assert [tuple(r) for r in top.collect()] == [("k1", 2)]
    with pytest.raises(ValueError):
        graph.optional(found, g, [("?other", "name", "?m")])
