import math

from pyspark.sql import functions as F

from corvina.functions import text as tx
from corvina.operators import index, vsm

BOOLEAN = [
    ("d1", "La red de agentes interceptó tráfico sospechoso en el nodo norte."),
    ("d2", "El agente de campo reportó actividad normal en la red interna."),
    ("d3", "Manual de procedimientos: la red no debe apagarse sin autorización."),
    ("d4", "Mantenimiento programado del agente automático de respaldo."),
]
RANKING = [
    ("a1", "Protocolo de evacuación silenciosa en instalaciones subterráneas."),
    ("a2", "Guía de rutas de escape y puntos de reunión sin alarmas audibles."),
    ("a3", "Receta de cocina: pasta con tomate y albahaca para el personal."),
    ("a4", "Mapa de salidas de emergencia y señalética fotoluminiscente."),
    ("a5", "Informe meteorológico: probabilidad de lluvia en la región este."),
]
LEVELS = [
    ("x1", "PUBLICO", "Boletín de prensa sobre obras en la avenida central y tráfico lento."),
    ("x2", "SIGILO", "Rumor operativo: el contacto cambió frecuencia; verificar handoff nocturno. ###FIN###"),
    ("x3", "PUBLICO", "Convocatoria a curso de primeros auxilios para voluntarios municipales."),
    ("x4", "SIGILO", "Inventario de papelería y tóner para el almacén B del cuartel general."),
    ("x5", "RESERVADO", "Lista de proveedores homologados para catering y cafetería interna."),
]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string")


def test_inverted_index(spark):
    lists = {r["term"]: r["postings"] for r in index.posting_lists(docs(spark, BOOLEAN)).collect()}
    assert len(lists) == 29
    assert lists["de"] == ["d1", "d2", "d3", "d4"] and lists["agente"] == ["d2", "d4"] and lists["red"] == ["d1", "d2", "d3"]
    p = index.postings(docs(spark, BOOLEAN))
    assert [r["doc_id"] for r in index.with_all(p, ["red", "agente"]).collect()] == ["d2"]
    assert index.with_all(p, ["red", "nada"]).count() == 0


def test_ranking_golden(spark):
    d = docs(spark, RANKING)
    s = {r["doc_id"]: round(r["score"], 4) for r in vsm.scores(d, "evacuación silenciosa rutas de escape emergencia").collect()}
    assert s == {"a1": 0.4018, "a2": 0.3700, "a3": 0.0327, "a4": 0.2617, "a5": 0.0354}
    assert vsm.term_counts(d).select("term").distinct().count() == 36
    top = vsm.top(vsm.scores(d, "evacuación silenciosa rutas de escape emergencia"), 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in top] == ["a1", "a2", "a4"]


def test_filter_before_ranking(spark):
    d = spark.createDataFrame(LEVELS, "doc_id string, nivel string, text string").where("nivel = 'SIGILO'")
    s = {r["doc_id"]: round(r["score"], 4) for r in vsm.scores(d, "contacto frecuencia operativo handoff nocturno").collect()}
    assert s == {"x2": 0.7252, "x4": 0.0}


def test_cosine_matrix(spark):
    w = vsm.tfidf(docs(spark, RANKING))
    m = {(r["doc_a"], r["doc_b"]): r["sim"] for r in vsm.cosine_matrix(w).collect()}
    assert len(m) == 25
    for (a, b), x in m.items():
        assert -1e-12 <= x <= 1 + 1e-12 and math.isclose(x, m[b, a]) and (a != b or x == 1.0)


def test_proximity(spark):
    d = docs(spark, [("p", "uno dos tres cuatro. cinco uno"), ("q", "dos. uno")])
    ts = tx.vector_tokens(F.col("text"))
    ids = lambda c: [r["doc_id"] for r in d.where(c).orderBy("doc_id").collect()]
    assert ids(index.phrase(ts, ["dos", "tres"])) == ["p"]
    assert ids(index.near(ts, "uno", "tres", 1)) == []
    assert ids(index.near(ts, "uno", "tres", 2)) == ["p"]
    assert ids(index.same_sentence(F.col("text"), "uno", "dos")) == ["p"]


def test_recommendations(spark):
    from corvina.operators import learners

    near = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.25), (0, 3, -1.0)], "query_id long, vec_id long, score double")
    ratings = spark.createDataFrame([(0, "seen", 5.0), (1, "seen", 5.0), (1, "p", 4.0), (2, "p", 1.0), (2, "q", 3.0), (3, "r", 5.0)], "vec_id long, item string, rating double")
    assert [tuple(r) for r in learners.recommend(near, ratings, 5).orderBy("rank").collect()] == [(0, 1, "p", 3.0), (0, 2, "q", 3.0)]
