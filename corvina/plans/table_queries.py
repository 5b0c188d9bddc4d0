"""Queries on the relational tables, embeddings, and tables derived from them."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import text as tx
from corvina.operators import cluster, eda, graph, learners, search, tables, vision, vsm
from corvina.plans.registry import Tables, query
from corvina.sources import feeds, files
from corvina.streaming import streams

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _union(template: str, columns) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


# ---- exploratory statistics


@query(
    "describe_numeric",
    _union("SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM lineitem", NUMBERS),
)
def _(t: Tables) -> DataFrame:
    return _rounded(eda.describe(t.lineitem, NUMBERS), "mean", "std", "q25", "q50", "q75")


_DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@query("null_counts", _union("SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null FROM documents", _DOC_COLUMNS))
def _(t: Tables) -> DataFrame:
    return eda.null_counts(t.documents, _DOC_COLUMNS)


@query("null_map", "SELECT d.doc_id, quality IS NULL AS quality_null, toxic IS NULL AS toxic_null FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t: Tables) -> DataFrame:
    return eda.null_map(t.documents.join(t.labels, "doc_id", "left"), "doc_id", ["quality", "toxic"])


@query("duplicate_rows", "SELECT coalesce(sum(k - 1), 0)::BIGINT AS n FROM (SELECT count(*) AS k FROM documents GROUP BY text, lang)")
def _(t: Tables) -> DataFrame:
    return eda.duplicate_rows(t.documents.select("text", "lang"))


@query("value_counts", "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    return eda.value_counts(t.events, "event_type")


@query("counts_of_counts", "SELECT DISTINCT n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def _(t: Tables) -> DataFrame:
    return eda.counts_of_counts(t.orders, "o_custkey")


@query("filtered_counts", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_linestatus = 'O' GROUP BY l_returnflag")
def _(t: Tables) -> DataFrame:
    return eda.value_counts(t.lineitem.where(F.col("l_quantity").between(10, 20) & (F.col("l_linestatus") == "O")).select("l_returnflag"), "l_returnflag")


@query("outlier_bound", _union("SELECT '{c}' AS \"column\", round(avg({c}) + 3 * stddev_samp({c}), 6) AS bound FROM lineitem", NUMBERS))
def _(t: Tables) -> DataFrame:
    return _rounded(eda.outlier_bound(t.lineitem, NUMBERS), "bound")


@query("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in NUMBERS for b in NUMBERS))
def _(t: Tables) -> DataFrame:
    return _rounded(eda.correlations(t.lineitem, NUMBERS), "r")


_PRIORITIES = ["F", "O", "P"]
_CROSS = "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{v}') AS c_{v}" for v in _PRIORITIES) + " FROM orders GROUP BY o_orderpriority"


@query("crosstab", _CROSS)
def _(t: Tables) -> DataFrame:
    return eda.crosstab(t.orders, "o_orderpriority", "o_orderstatus", _PRIORITIES)


@query("crosstab_mean", f"WITH x AS ({_CROSS}) " + _union("SELECT 'c_{c}' AS \"column\", count(c_{c}) AS count, sum(c_{c})::BIGINT AS sum, round(avg(c_{c}), 6) AS mean, round(stddev_samp(c_{c}), 6) AS std, min(c_{c})::DOUBLE AS min, round(quantile_cont(c_{c}, 0.25), 6) AS q25, round(quantile_cont(c_{c}, 0.5), 6) AS q50, round(quantile_cont(c_{c}, 0.75), 6) AS q75, max(c_{c})::DOUBLE AS max FROM x", _PRIORITIES))
def _(t: Tables) -> DataFrame:
    return _rounded(eda.crosstab_summary(eda.crosstab(t.orders, "o_orderpriority", "o_orderstatus", _PRIORITIES), "o_orderpriority"), "mean", "std", "q25", "q50", "q75")


@query(
    "histogram",
    "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(19, floor((value - lo) / ((hi - lo) / 20))) END::INT AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY ALL) "
    "SELECT g.bin::INT AS bin, round(lo + g.bin * ((hi - lo) / 20), 6) AS low, round(lo + (g.bin + 1) * ((hi - lo) / 20), 6) AS high, coalesce(n, 0) AS n FROM (SELECT unnest(range(20)) AS bin) g CROSS JOIN e LEFT JOIN b ON b.bin = g.bin",
)
def _(t: Tables) -> DataFrame:
    return _rounded(eda.histogram(t.events, "value", 20), "low", "high")


@query(
    "boxplot_stats",
    "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY event_type), x AS (SELECT *, value BETWEEN q25 - (q75 - q25) * 1.5::DOUBLE AND q75 + (q75 - q25) * 1.5::DOUBLE AS inside FROM events JOIN q USING (event_type)) "
    "SELECT event_type, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, min(value) FILTER (inside) AS low, max(value) FILTER (inside) AS high, count(*) FILTER (NOT inside) AS n_outliers FROM x GROUP BY ALL",
)
def _(t: Tables) -> DataFrame:
    return _rounded(eda.box(t.events, "event_type", "value"), "q25", "q50", "q75")


@query("shares", "SELECT p_brand, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part), 6) AS pct FROM part GROUP BY p_brand")
def _(t: Tables) -> DataFrame:
    return _rounded(eda.shares(t.part, "p_brand"), "pct")


@query(
    "kernel_density",
    "WITH st AS (SELECT event_type, min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) AS s FROM events WHERE value IS NOT NULL GROUP BY event_type HAVING stddev_samp(value) > 0), g AS (SELECT i, min(lo) + i * (max(hi) - min(lo)) / 31 AS point FROM st, (SELECT unnest(range(32)) AS i) GROUP BY i) "
    "SELECT event_type, i::INT AS i, round(point, 6) AS point, round(sum(exp(-0.5::DOUBLE * pow((point - value) / (s * pow(n, -0.2::DOUBLE)), 2)) / (s * pow(n, -0.2::DOUBLE) * 2.5066282746310002::DOUBLE) / n), 9) AS density FROM events JOIN st USING (event_type) CROSS JOIN g WHERE value IS NOT NULL GROUP BY event_type, i, point",
)
def _(t: Tables) -> DataFrame:
    return _rounded(_rounded(eda.density(t.events, "event_type", "value"), "density", places=9), "point")


@query("first_and_last", "(SELECT 'first' AS part, o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5) UNION ALL (SELECT 'last', o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5)")
def _(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_totalprice")
    return o.orderBy("o_orderkey").limit(5).select(F.lit("first").alias("part"), "*").unionByName(o.orderBy(F.desc("o_orderkey")).limit(5).select(F.lit("last").alias("part"), "*"))


# ---- projections, joins, strings


@query("derive_flag", "SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN 'large' ELSE 'small' END AS size, 0 AS zero FROM orders")
def _(t: Tables) -> DataFrame:
    return tables.constants(t.orders.select("o_orderkey", eda.flag(F.col("o_totalprice") >= 100000, "large", "small").alias("size")), zero=0)


@query("last_char_filter", "SELECT count(*) AS n FROM part WHERE substr(p_type, -1, 1) = 'D'")
def _(t: Tables) -> DataFrame:
    return t.part.where(tables.last_character(F.col("p_type")) == "D").agg(F.count(F.lit(1)).alias("n"))


@query("left_join_labels", "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")


@query("renamed_columns", "SELECT r_regionkey AS id, r_name AS name FROM region")
def _(t: Tables) -> DataFrame:
    return tables.renamed(t.region.select("r_regionkey", "r_name"), ["id", "name"])


@query("format_prediction", "SELECT doc_id AS id, 'quality ' || quality || ' 0 0 1 1 toxic ' || toxic || ' 0 0 1 1' AS prediction FROM labels")
def _(t: Tables) -> DataFrame:
    return t.labels.select(F.col("doc_id").alias("id"), tables.prediction_string(["quality", "toxic"]).alias("prediction"))


@query("format_decimals", "SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice) AS price FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", tables.decimals(F.col("l_extendedprice"), 2).alias("price"))


@query("label_names", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'normal' END AS name FROM labels")
def _(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", eda.flag(F.col("toxic") == 1, "toxic", "normal").alias("name"))


@query("ensemble_mean", "SELECT user_id, round(avg(value), 6) AS value FROM events GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    return _rounded(tables.ensemble_mean(t.events, "user_id", ["value"]), "value")


@query("coalesced_fields", "SELECT d.doc_id, coalesce(l.quality, l.toxic, -1) AS q, coalesce(d.lang, '') AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", "toxic", F.lit(-1)).alias("q"), F.coalesce("lang", F.lit("")).alias("lang"))


@query("first_n_per_source", "SELECT source, doc_id, pos FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS pos FROM documents) WHERE pos <= 20")
def _(t: Tables) -> DataFrame:
    return eda.first_per_group(t.documents.select("source", "doc_id"), ["source"], ["doc_id"], 20)


@query("date_filter", "SELECT event_id, event_type FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'")
def _(t: Tables) -> DataFrame:
    return t.events.where(search.on_date(F.col("ts"), "2024-01-05", "2024-01-07")).select("event_id", "event_type")


@query("dataset_map", "SELECT c_custkey, reverse(c_name) AS backwards FROM customer")
def _(t: Tables) -> DataFrame:
    return tables.map_batches(t.customer.select("c_custkey", "c_name"), lambda f: f.assign(backwards=f["c_name"].str[::-1])[["c_custkey", "backwards"]], "c_custkey long, backwards string")


@query("appended_rows", "SELECT 'customer' AS kind, c_custkey AS id, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, NULL FROM supplier")
def _(t: Tables) -> DataFrame:
    return eda.union_all([t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"))])


@query("set_difference", "SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_nationkey").subtract(t.supplier.select("s_nationkey"))


@query("set_intersection", "SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_nationkey").intersect(t.supplier.select("s_nationkey"))


# ---- triples

_G = """g AS (SELECT DISTINCT * FROM (
  SELECT 'nation:' || n_nationkey AS s, 'name' AS p, n_name AS o FROM nation UNION ALL SELECT 'nation:' || n_nationkey, 'region', 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'name', r_name FROM region UNION ALL SELECT 'customer:' || c_custkey, 'nation', 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'customer:' || c_custkey, 'segment', c_mktsegment FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'supplier:' || s_suppkey, 'name', s_name FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'name', c_name FROM customer))"""


def _graph(t: Tables) -> DataFrame:
    def triples(df, kind, key, p, o):
        return df.select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"))

    ref = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    return graph.graph(
        eda.union_all(
            [
                triples(t.nation, "nation", "n_nationkey", "name", F.col("n_name")),
                triples(t.nation, "nation", "n_nationkey", "region", ref("region", "n_regionkey")),
                triples(t.region, "region", "r_regionkey", "name", F.col("r_name")),
                triples(t.customer, "customer", "c_custkey", "nation", ref("nation", "c_nationkey")),
                triples(t.customer, "customer", "c_custkey", "segment", F.col("c_mktsegment")),
                triples(t.customer, "customer", "c_custkey", "name", F.col("c_name")),
                triples(t.supplier, "supplier", "s_suppkey", "nation", ref("nation", "s_nationkey")),
                triples(t.supplier, "supplier", "s_suppkey", "name", F.col("s_name")),
            ]
        )
    )


@query("triples_size", f"WITH {_G} SELECT count(*) AS n FROM g")
def _(t: Tables) -> DataFrame:
    return _graph(t).agg(F.count(F.lit(1)).alias("n"))


@query("triples_coverage", f"WITH {_G} SELECT x.p, x.p IN (SELECT p FROM g) AS present FROM (VALUES ('name'), ('nation'), ('author'), ('year')) x(p)")
def _(t: Tables) -> DataFrame:
    return graph.coverage(_graph(t), t.spark.createDataFrame([("name",), ("nation",), ("author",), ("year",)], "p string"))


@query("triple_pattern", f"WITH {_G} SELECT DISTINCT s, o FROM g WHERE p = 'region'")
def _(t: Tables) -> DataFrame:
    return graph.simple_pattern(_graph(t), p="region")


@query("bgp_join", f"WITH {_G} SELECT a.s AS who, a.o AS n, b.o AS r, c.o AS region FROM g a JOIN g b ON a.o = b.s JOIN g c ON b.o = c.s WHERE a.p = 'nation' AND b.p = 'region' AND c.p = 'name'")
def _(t: Tables) -> DataFrame:
    return graph.bgp(_graph(t), [("?who", "nation", "?n"), ("?n", "region", "?r"), ("?r", "name", "?region")])


@query("bgp_union", f"WITH {_G} SELECT a.s AS who, a.o AS name FROM g a JOIN g b ON a.s = b.s WHERE a.p = 'name' AND b.p = 'nation' UNION ALL SELECT a.s, a.o FROM g a JOIN g b ON a.s = b.s WHERE a.p = 'name' AND b.p = 'segment'")
def _(t: Tables) -> DataFrame:
    g = _graph(t)
    return graph.bgp_with_union(g, [("?who", "name", "?name")], [[("?who", "nation", "?n")], [("?who", "segment", "?s")]]).select("who", "name")


@query("bgp_optional", f"WITH {_G} SELECT a.s AS who, a.o AS name, b.o AS segment FROM g a LEFT JOIN g b ON a.s = b.s AND b.p = 'segment' WHERE a.p = 'name'")
def _(t: Tables) -> DataFrame:
    g = _graph(t)
    return graph.optional(graph.match(g, ("?who", "name", "?name")), g, [("?who", "segment", "?segment")])


@query("bgp_aggregate", f"WITH {_G} SELECT c.o AS region, count(*) AS n, count(DISTINCT a.o) AS n_nations FROM g a JOIN g b ON a.o = b.s JOIN g c ON b.o = c.s WHERE a.p = 'nation' AND b.p = 'region' AND c.p = 'name' GROUP BY c.o HAVING count(*) >= 2 ORDER BY n DESC, region LIMIT 3")
def _(t: Tables) -> DataFrame:
    found = graph.bgp(_graph(t), [("?who", "nation", "?n"), ("?n", "region", "?r"), ("?r", "name", "?region")])
    counts = {"n": F.count(F.lit(1)), "n_nations": F.count_distinct("n")}
    return graph.aggregate(found, ["region"], having=F.col("n") >= 2, order=[F.desc("n"), "region"], limit=3, **counts)


@query("prefixed_pattern", f"WITH {_G} SELECT DISTINCT p, o FROM g WHERE s = 'nation:7'")
def _(t: Tables) -> DataFrame:
    return graph.simple_pattern(_graph(t), s=graph.expand({"n": "nation:"}, "n:7"))


@query("typed_triples", f"WITH {_G} SELECT s, p, o, CASE WHEN p IN ('nation', 'region') THEN 'uri' ELSE 'literal' END AS o_kind, NULL::VARCHAR AS o_lang, CASE WHEN p NOT IN ('nation', 'region') THEN 'xsd:string' END AS o_datatype FROM g")
def _(t: Tables) -> DataFrame:
    is_uri = F.col("p").isin("nation", "region")
    return graph.typed(_graph(t).withColumn("o_kind", F.when(is_uri, "uri").otherwise("literal")).withColumn("o_datatype", F.when(~is_uri, "xsd:string")))


@query(
    "resolve_entity",
    "SELECT c.name, coalesce(n1.n_name, n2.n_name, c.name) AS resolved FROM (SELECT 'nation:' || c_nationkey AS name FROM customer UNION ALL SELECT c_name FROM customer UNION ALL SELECT 'unknown:' || c_custkey FROM customer) c "
    "LEFT JOIN nation n1 ON c.name = 'nation:' || n1.n_nationkey LEFT JOIN customer k ON k.c_name = c.name LEFT JOIN nation n2 ON n2.n_nationkey = k.c_nationkey",
)
def _(t: Tables) -> DataFrame:
    ref = lambda c: F.concat(F.lit("nation:"), F.col(c))
    c = t.customer
    names = eda.union_all([c.select(ref("c_nationkey").alias("name")), c.select(F.col("c_name").alias("name")), c.select(F.concat(F.lit("unknown:"), F.col("c_custkey")).alias("name"))])
    return graph.resolve(names, t.nation.select(ref("n_nationkey").alias("uri"), F.col("n_name").alias("label")), c.select(F.col("c_name").alias("name"), ref("c_nationkey").alias("uri")))


@query("same_as_classes", "SELECT s AS node, min(o) OVER (PARTITION BY r) AS canonical FROM (SELECT 'customer:' || c_custkey AS s, c_nationkey AS r, 'customer:' || c_custkey AS o FROM customer UNION ALL SELECT 'x:nation:' || c_nationkey, c_nationkey, 'customer:zzz' FROM (SELECT DISTINCT c_nationkey FROM customer))")
def _(t: Tables) -> DataFrame:
    return graph.same_classes(t.customer.select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("a"), F.concat(F.lit("x:nation:"), F.col("c_nationkey")).alias("b")))


# ---- vectors and learners

_COS = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_cosine_similarity(q.e, v.e), 12) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)"


def _near(t: Tables) -> DataFrame:
    return learners.neighbours(t.embeddings, F.col("vec_id") % 50 == 0, 5)


@query("embedding_cosine_topk", f"{_COS} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5")
def _(t: Tables) -> DataFrame:
    return _rounded(_near(t), "score")


@query("embedding_knn_vote", f"{_COS} SELECT query_id, label AS predicted FROM (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, label) AS k FROM r WHERE rank <= 5 GROUP BY query_id, label) WHERE k = 1")
def _(t: Tables) -> DataFrame:
    return learners.vote(_near(t), t.embeddings.select("vec_id", "label"))


@query("euclidean_topk", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(-list_distance(q.e, v.e), 9) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, rank, vec_id, round(score, 5) AS score FROM r WHERE rank <= 5")
def _(t: Tables) -> DataFrame:
    return _rounded(learners.neighbours(t.embeddings, F.col("vec_id") % 50 == 0, 5, metric="euclidean"), "score", places=5)


@query(
    "neighbour_recommendations",
    f"{_COS}, ra AS (SELECT user_id AS vec_id, event_type AS item, avg(value) AS rating FROM events WHERE value IS NOT NULL GROUP BY ALL), rec AS (SELECT query_id, item, sum(score * rating) / sum(score) AS score FROM r JOIN ra USING (vec_id) WHERE rank <= 5 AND score > 0 GROUP BY ALL), "
    "new AS (SELECT * FROM rec WHERE NOT EXISTS (SELECT 1 FROM ra WHERE ra.vec_id = rec.query_id AND ra.item = rec.item)) SELECT query_id, rank, item, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item)::INT AS rank FROM new) WHERE rank <= 3",
)
def _(t: Tables) -> DataFrame:
    ratings = t.events.where("value is not null").groupBy(F.col("user_id").alias("vec_id"), F.col("event_type").alias("item")).agg(F.avg("value").alias("rating"))
    return _rounded(learners.recommend(_near(t), ratings, 3), "score")


def _knn_edges(t: Tables) -> DataFrame:
    near = learners.neighbours(t.embeddings, F.lit(True), 5)
    return learners.checkpointed(near.select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), F.greatest("score", F.lit(0.0)).alias("w")).where("w > 0"))


#: Labels are known of those vectors, about a third, whose id has such a hash: a property of the task.
_KNOWN = "md5(CAST(vec_id AS VARCHAR)) < '5'"


def _known() -> Column:
    return F.md5(F.col("vec_id").cast("string").cast("binary")) < "5"


def _seeds(t: Tables) -> DataFrame:
    return t.embeddings.where(_known()).select(F.col("vec_id").alias("node"), "label")


def _spread_sql(rounds: int, alpha: float | None) -> str:
    """The rounds of propagation (spreading, with alpha) one after the other."""
    out = [
        "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)",
        "s AS (SELECT q.vec_id AS a, v.vec_id AS b, round(list_cosine_similarity(q.e, v.e), 12) AS w FROM v q JOIN v ON q.vec_id <> v.vec_id)",
        "r AS MATERIALIZED (SELECT a, b, greatest(w, 0.0::DOUBLE) AS w FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS k FROM s) WHERE k <= 5 AND w > 0)",
        "e AS MATERIALIZED (SELECT a, b, max(w) AS w FROM (SELECT a, b, w FROM r UNION ALL SELECT b, a, w FROM r) GROUP BY a, b)",
        "d AS MATERIALIZED (SELECT a, sum(w) AS d FROM e GROUP BY a)",
        "walk AS MATERIALIZED (SELECT e.a, e.b, " + ("w / x.d" if alpha is None else "w / sqrt(x.d * y.d)") + " AS w FROM e JOIN d x ON x.a = e.a JOIN d y ON y.a = e.b)",
        f"p0 AS MATERIALIZED (SELECT vec_id AS node, label, 1.0::DOUBLE AS p FROM embeddings WHERE {_KNOWN})",
    ]
    for k in range(rounds):
        moved = f"SELECT a AS node, label, sum(w * p) AS p FROM walk JOIN p{k} ON walk.b = p{k}.node GROUP BY a, label"
        if alpha is None:
            step = f"SELECT node, label, p / sum(p) OVER (PARTITION BY node) AS p FROM ({moved}) WHERE node NOT IN (SELECT node FROM p0) UNION ALL SELECT node, label, p FROM p0"
        else:
            step = f"SELECT node, label, sum(p) AS p FROM (SELECT node, label, p * {alpha}::DOUBLE AS p FROM ({moved}) UNION ALL SELECT node, label, p * {1 - alpha}::DOUBLE FROM p0) GROUP BY node, label"
        out.append(f"p{k + 1} AS MATERIALIZED ({step})")
    return ", ".join(out) + f" SELECT node, label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(p, 12) DESC, label) AS r FROM p{rounds}) WHERE r = 1"


@query("label_propagation", _spread_sql(5, None))
def _(t: Tables) -> DataFrame:
    return learners.best_label(learners.propagate(_knn_edges(t), _seeds(t), 5))


@query("label_spreading", _spread_sql(5, 0.8))
def _(t: Tables) -> DataFrame:
    return learners.best_label(learners.propagate(_knn_edges(t), _seeds(t), 5, alpha=0.8))


#: Gaussian naive Bayes: means and variances by label and place, the variances raised by a billionth of the largest.
_GAUSSIAN = f"""WITH x AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), tr AS (SELECT * FROM x WHERE NOT ({_KNOWN})),
  m AS (SELECT label, k, avg(x) AS m, var_pop(x) + 1e-9::DOUBLE * (SELECT max(v) FROM (SELECT var_pop(x) AS v FROM tr GROUP BY k)) AS v, count(*) AS n FROM tr GROUP BY label, k),
  s AS (SELECT vec_id, m.label, sum(-0.5::DOUBLE * ln(v) - 0.5::DOUBLE * (x - m) * (x - m) / v) + ln(max(n)) AS s FROM x JOIN m USING (k) GROUP BY vec_id, m.label)
  SELECT vec_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, label) AS r FROM s) WHERE r = 1"""


def _learner(name: str):
    @query(f"learner_{name}", _GAUSSIAN if name == "gaussian_nb" else None)
    def _(t: Tables) -> DataFrame:
        # trained on about two thirds, applied to all
        train = t.embeddings.where(~_known())
        return learners.fit_predict(name, train, t.embeddings)


for _name in learners.MODELS:
    _learner(_name)


@query("kmeans_clusters")
def _(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", cluster.dense(F.col("embedding")).alias("features"))
    return cluster.kmeans(rows, 4, 42, 10).transform(rows).select("vec_id", "prediction")


def _capped(t: Tables) -> tuple[DataFrame, DataFrame]:
    counts = vsm.term_counts(t.documents)
    terms = learners.checkpointed(vsm.cap(counts, 100).select("term").withColumn("place", F.row_number().over(Window.orderBy("term")) - 1))
    w = vsm.tfidf(t.documents, max_features=100)
    return learners.checkpointed(cluster.vectors(w, terms)), terms


@query("cluster_top_terms")
def _(t: Tables) -> DataFrame:
    rows, terms = _capped(t)
    return cluster.centroid_terms(t.spark, cluster.kmeans(rows, 4, 42, 10), [r["term"] for r in terms.orderBy("place").collect()])


@query("cluster_members")
def _(t: Tables) -> DataFrame:
    rows, _terms = _capped(t)
    return cluster.members(cluster.kmeans(rows, 2, 42, 10).transform(rows).select("doc_id", "prediction"))


@query("svd_2d")
def _(t: Tables) -> DataFrame:
    rows, _terms = _capped(t)
    return cluster.truncated_svd(rows, 2)


@query("cluster_scatter")
def _(t: Tables) -> DataFrame:
    rows, _terms = _capped(t)
    labels = cluster.kmeans(rows, 4, 42, 10).transform(rows).select("doc_id", "prediction")
    return cluster.truncated_svd(rows, 2).join(labels, "doc_id")


# ---- pixels: images are made of tables by arithmetic


def _pixels(t: Tables) -> DataFrame:
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return t.lineitem.select((F.col("l_suppkey") % 50).alias("image"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), ((k * 37) % 256).cast("int").alias("b"), ((k * 91) % 256).cast("int").alias("g"), ((k * 53) % 256).cast("int").alias("r"))


_PIX = "px AS (SELECT l_suppkey % 50 AS image, l_orderkey * 8 + l_linenumber AS pos, ((l_orderkey * 7 + l_linenumber) * 37 % 256)::INT AS b, ((l_orderkey * 7 + l_linenumber) * 91 % 256)::INT AS g, ((l_orderkey * 7 + l_linenumber) * 53 % 256)::INT AS r FROM lineitem)"
_HSV = """h0 AS (SELECT *, greatest(b, g, r) AS mx, greatest(b, g, r) - least(b, g, r) AS d FROM px),
  h1 AS (SELECT *, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN mx = r THEN 60 * (g - b)::DOUBLE / d WHEN mx = g THEN 120 + 60 * (b - r)::DOUBLE / d ELSE 240 + 60 * (r - g)::DOUBLE / d END AS hue FROM h0),
  h2 AS (SELECT *, round(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2)::INT AS h3, CASE WHEN mx = 0 THEN 0 ELSE round(255::DOUBLE * d / mx)::INT END AS s, mx AS v FROM h1),
  hsv AS (SELECT image, pos, b, g, r, CASE WHEN h3 >= 180 THEN h3 - 180 ELSE h3 END AS h, s, v FROM h2)"""


def _in(low, high) -> str:
    return "(" + " AND ".join(f"{c} BETWEEN {a} AND {b}" for c, a, b in zip("hsv", low, high)) + ")"


@query("hsv_pixels", f"WITH {_PIX}, {_HSV} SELECT image, pos, h, s, v FROM hsv")
def _(t: Tables) -> DataFrame:
    return vision.hsv(_pixels(t)).select("image", "pos", "h", "s", "v")


@query(
    "color_shares",
    f"WITH {_PIX}, {_HSV}, c AS (SELECT image, count(*) FILTER (NOT {_in(*vision.WHITE)}) AS n_pixels, "
    + ", ".join(f"count(*) FILTER (NOT {_in(*vision.WHITE)} AND ({' OR '.join(_in(*x) for x in v)})) AS {k}" for k, v in vision.COLOURS.items())
    + " FROM hsv GROUP BY image) SELECT *, CASE greatest(Verde, Azul, Amarillo, Rojo) WHEN Verde THEN 'Verde' WHEN Azul THEN 'Azul' WHEN Amarillo THEN 'Amarillo' ELSE 'Rojo' END AS predominant, round(greatest(Verde, Azul, Amarillo, Rojo) * 100 / n_pixels, 6) AS pct FROM c WHERE n_pixels > 0",
)
def _(t: Tables) -> DataFrame:
    return _rounded(vision.colour_shares(_pixels(t)), "pct")


@query("masked_pixels", f"WITH {_PIX}, {_HSV} SELECT image, pos, " + ", ".join(f"CASE WHEN {_in(*vision.SINGLE_RANGE)} THEN {c} ELSE 0 END AS {c}" for c in "bgr") + " FROM hsv")
def _(t: Tables) -> DataFrame:
    return vision.masked(vision.hsv(_pixels(t)), vision.in_range(*vision.SINGLE_RANGE)).select("image", "pos", "b", "g", "r")


@query("min_max_scale", f"WITH {_PIX}, x AS (SELECT image, pos, v - min(v) OVER (PARTITION BY image) AS x FROM (SELECT image, pos, max(r) OVER (PARTITION BY image) - r AS v FROM px)) SELECT image, pos, CASE WHEN max(x) OVER (PARTITION BY image) = 0 THEN 0 ELSE trunc(x::DOUBLE / max(x) OVER (PARTITION BY image) * 255)::INT END AS r FROM x")
def _(t: Tables) -> DataFrame:
    return vision.min_max_scale(_pixels(t), "r", invert=True).select("image", "pos", "r")


def _squares(t: Tables) -> DataFrame:
    """An image of 12 by 8 grey values for each nation."""
    at = t.nation.select(F.col("n_nationkey").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return at.withColumn("v", ((F.col("image") * 37 + F.col("x") * 91 + F.col("y") * 53) % 256).cast("int"))


_SQUARES = "sq AS (SELECT n_nationkey AS image, x::INT AS x, y::INT AS y, ((n_nationkey * 37 + x * 91 + y * 53) % 256)::INT AS v FROM nation, (SELECT unnest(range(12)) AS x), (SELECT unnest(range(8)) AS y))"


@query("decoded_pixels", f"WITH {_SQUARES} SELECT image, x, y, round(v / 355.0::DOUBLE, 9) AS v FROM sq")
def _(t: Tables) -> DataFrame:
    return _rounded(vision.decoded(_squares(t), ["v"]), "v", places=9)


@query("flipped_pixels", f"WITH {_SQUARES} SELECT image, CASE WHEN md5(image || ':7:x') < '8' THEN 11 - x ELSE x END AS x, CASE WHEN md5(image || ':7:y') < '8' THEN 7 - y ELSE y END AS y, v FROM sq")
def _(t: Tables) -> DataFrame:
    return vision.flipped(_squares(t), 12, 8, 7)


@query(
    "resized_pixels",
    f"WITH {_SQUARES}, tx AS (SELECT x, floor((x + 0.5::DOUBLE) * 12 / 5 - 0.5::DOUBLE) AS lo, (x + 0.5::DOUBLE) * 12 / 5 - 0.5::DOUBLE AS pos FROM (SELECT unnest(range(5))::INT AS x)), ty AS (SELECT y, floor((y + 0.5::DOUBLE) * 8 / 10 - 0.5::DOUBLE) AS lo, (y + 0.5::DOUBLE) * 8 / 10 - 0.5::DOUBLE AS pos FROM (SELECT unnest(range(10))::INT AS y)), "
    "wx AS (SELECT x, greatest(0, least(11, lo + i)) AS sx, CASE WHEN i = 0 THEN 1 - (pos - lo) ELSE pos - lo END AS w FROM tx, (SELECT unnest(range(2)) AS i)), wy AS (SELECT y, greatest(0, least(7, lo + i)) AS sy, CASE WHEN i = 0 THEN 1 - (pos - lo) ELSE pos - lo END AS w FROM ty, (SELECT unnest(range(2)) AS i)) "
    "SELECT image, wx.x, wy.y, round(sum(wx.w * wy.w * v), 6) AS v FROM sq JOIN wx ON sq.x = sx JOIN wy ON sq.y = sy GROUP BY ALL",
)
def _(t: Tables) -> DataFrame:
    return _rounded(vision.resized(_squares(t), (12, 8), (5, 10)), "v")


def _hidden(t: Tables) -> DataFrame:
    """image, pos, bit of a name, the terminator and more behind it."""
    hidden = F.concat(F.col("n_name"), F.lit("###FIN###ignored"))
    chars = t.nation.select(F.col("n_nationkey").alias("image"), F.posexplode(F.split(hidden, "")).alias("c", "x")).where("x != ''")
    bits = chars.select("image", "c", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"), F.ascii("x").alias("code"))
    return bits.select("image", (F.col("c") * 8 + F.col("k")).alias("pos"), (F.floor(F.col("code") / F.pow(F.lit(2), 7 - F.col("k"))).cast("int") % 2).alias("bit"))


@query("masked_message", "SELECT n_nationkey AS image, n_name || '###FIN###' AS message FROM nation")
def _(t: Tables) -> DataFrame:
    # in the value channel of orange pixels, with black ones in between
    bits = _hidden(t)
    orange = bits.select("image", (F.col("pos") * 2 + 1).alias("pos"), F.lit(0).alias("b"), F.lit(120).alias("g"), (F.lit(200) + F.col("bit")).alias("r"))
    black = bits.select("image", (F.col("pos") * 2).alias("pos"), F.lit(0).alias("b"), F.lit(0).alias("g"), F.lit(0).alias("r"))
    return vision.masked_message(orange.unionByName(black))


@query(
    "lsb_message",
    "SELECT n_nationkey AS image, n_name || '###FIN###' AS message FROM nation",
)
def _(t: Tables) -> DataFrame:
    # a name in the lowest bits of grey values is read back
    return vision.grey_message(_hidden(t).select("image", "pos", (F.lit(100) + F.col("bit")).alias("v")))


@query("bits_to_text", "SELECT r_regionkey, upper(r_name) AS name FROM region")
def _(t: Tables) -> DataFrame:
    codes = F.transform(F.filter(F.split(F.upper("r_name"), ""), lambda x: x != ""), lambda x: tx.bits_to_character(F.lpad(F.bin(F.ascii(x)), 8, "0")))
    return t.region.select("r_regionkey", F.array_join(codes, "").alias("name"))


# ---- windowed counts: the batch form of the streaming operator


@query("event_window_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    out = streams.tumbling_counts(t.events, "ts", "event_type")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


# ---- sources and sinks: tables written to the shared folder are read back


def _folder(t: Tables, name: str) -> str:
    return f"{learners.shared_folder(t.spark)}/{name}-{uuid4().hex}"


_PARTS = "SELECT p_partkey, p_name || ', \"' || p_type || '\"' AS p_name, p_size FROM part"


def _parts(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("p_name"), "p_size")


def _csv(t: Tables, bom: bool) -> DataFrame:
    folder = _folder(t, "csv")
    files.write_csv(_parts(t), folder, bom)
    types = {f.name: f.dataType for f in _parts(t).schema}
    back = files.csv(t.spark, folder)
    return back.select(*(F.col(c).cast(types[c]) for c in back.columns))


@query("csv_round_trip", _PARTS)
def _(t: Tables) -> DataFrame:
    return _csv(t, False)


@query("csv_marked_round_trip", _PARTS)
def _(t: Tables) -> DataFrame:
    return _csv(t, True)


@query("json_round_trip", _PARTS)
def _(t: Tables) -> DataFrame:
    folder = _folder(t, "json")
    files.write_json(_parts(t), folder)
    return t.spark.read.schema(_parts(t).schema).json(folder)


@query("json_array_read", "SELECT n_nationkey, n_name FROM nation")
def _(t: Tables) -> DataFrame:
    folder = _folder(t, "array")
    # an array for each of 25 rows, with a line break inside
    t.nation.select(F.concat(F.lit("[\n"), F.to_json(F.struct("n_nationkey", "n_name")), F.lit("]")).alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").option("lineSep", " ").text(folder)
    return files.json_array(t.spark, f"{folder}/*", "n_nationkey long, n_name string")


@query("text_folder_read", "SELECT n_name || chr(10) AS text FROM nation")
def _(t: Tables) -> DataFrame:
    folder = _folder(t, "texts")
    t.nation.select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").text(folder)
    return files.text_folder(t.spark, folder).select("text")


@query(
    "feed_items",
    "SELECT r_name AS source, n_name || ' & <co>' AS title, 'http://x/?a=1&n=' || n_nationkey AS link, '<p>' || n_name || ' &amp; raw</p>' AS summary, NULL AS error, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1)::INT AS pos, lower(n_name) || ' ' || lower(n_name) || ' amp raw' AS text_clean FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT NULL, NULL, NULL, NULL, 'not a feed', 0, NULL",
)
def _(t: Tables) -> DataFrame:
    item = F.concat(F.lit("<item><title>"), "n_name", F.lit(" &amp; &lt;co&gt;</title><link>http://x/?a=1&#38;n="), F.col("n_nationkey").cast("string"), F.lit("</link><description><![CDATA[<p>"), "n_name", F.lit(" &amp; raw</p>]]></description></item>"))
    entries = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("x")))).alias("xs"))  # 25 rows
    body = F.concat(F.lit("<rss><channel><title>"), "r_name", F.lit("</title>"), F.array_join(F.transform("xs", lambda e: e["x"]), ""), F.lit("</channel></rss>"))
    good = entries.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("url"), body.alias("body"))
    # what looks like a tag in a title is cleaned away
    rows = feeds.items(good.unionByName(t.spark.createDataFrame([("none", "no feed")], "url string, body string")))
    return feeds.with_clean_text(rows).select("source", "title", "link", "summary", "error", "pos", "text_clean")
