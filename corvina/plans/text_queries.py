"""Queries on documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import lexicon
from corvina.functions import text as tx
from corvina.functions.lexicon import HYPERBOLE, INLINE_STOP_WORDS, NEGATIONS
from corvina.operators import classify, index, learners, search, vsm
from corvina.plans.registry import Tables, query


def _tok(c: str = "text") -> str:
    return r"regexp_extract_all(lower(%s), '[\p{L}\p{N}_]{2,}')" % c


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


TOK = _tok()
ANALYSED = r"regexp_extract_all(regexp_replace(lower(text), '[.:,]', '', 'g'), '[^\s\p{Z}]+')"
CLEAN = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(%s, ''), '<[^>]+>', ' ', 'g'), '[^\p{L}\p{N}_\s\p{Z}]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')))"
NORM = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), "
    r"'https?://[^\s\p{Z}]+|www\.[^\s\p{Z}]+', ' ', 'g'), '@[\p{L}\p{N}_]+', ' ', 'g'), '#[\p{L}\p{N}_]+', ' ', 'g'), '[^a-záéíóúñü0-9\s\p{Z}]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'))"
)
#: A query on words that the tables hold.
RANKED = "licensed under the apache license version"
ENGLISH = "i me my we our you your he she it they the a an and or of to in on for with by from at as is are was be this that not".split()


# ---- tokens and frequencies


@query("tokens_per_doc", f"SELECT doc_id, len({TOK}) AS n_tokens, len(list_distinct({TOK})) AS n_distinct FROM documents")
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", tx.vector_tokens(F.col("text")).alias("ts"))
    return rows.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.size(F.array_distinct("ts")).cast("long").alias("n_distinct"))


@query("top_terms", f"SELECT term, count(*) AS n FROM (SELECT unnest({TOK}) AS term FROM documents) GROUP BY term ORDER BY n DESC, term LIMIT 50")
def _(t: Tables) -> DataFrame:
    return vsm.cap(vsm.term_counts(t.documents), 50)


@query(
    "top_terms_by_lang",
    f"SELECT lang, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest({TOK}) AS term FROM documents) GROUP BY ALL)) WHERE rank <= 20",
)
def _(t: Tables) -> DataFrame:
    n = t.documents.select("lang", F.explode(tx.vector_tokens(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))
    return n.withColumn("rank", rank.cast("long")).where("rank <= 20")


@query(
    "stopword_reduction",
    f"SELECT lang, sum(b)::BIGINT AS n_before, sum(a)::BIGINT AS n_after, round((sum(b) - sum(a)) * 100.0 / sum(b), 6)::DOUBLE AS pct FROM (SELECT lang, len({TOK}) AS b, len(list_filter({TOK}, lambda x: NOT list_contains({_list(ENGLISH)}, x))) AS a FROM documents) GROUP BY lang",
)
def _(t: Tables) -> DataFrame:
    ts = tx.vector_tokens(F.col("text"))
    n = t.documents.select("lang", F.size(ts).alias("b"), F.size(tx.without(ts, ENGLISH)).alias("a")).groupBy("lang").agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))
    return n.withColumn("pct", F.round((F.col("n_before") - F.col("n_after")) * 100.0 / F.col("n_before"), 6))


@query("inline_stopwords", f"SELECT doc_id, len(list_filter({TOK}, lambda x: NOT list_contains({_list(INLINE_STOP_WORDS)}, x))) AS n_kept FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(tx.without(tx.vector_tokens(F.col("text")), INLINE_STOP_WORDS)).cast("long").alias("n_kept"))


@query(
    "alpha_tokens",
    r"SELECT doc_id, len(ts) AS n_all, len(list_filter(ts, lambda x: regexp_matches(x, '^\p{L}+$'))) AS n_alpha FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]') AS ts FROM documents)",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", tx.word_tokens(F.col("text")).alias("ts"))
    return rows.select("doc_id", F.size("ts").cast("long").alias("n_all"), F.size(tx.alphabetic(F.col("ts"))).cast("long").alias("n_alpha"))


@query("wordpunct_tokens", r"SELECT conv_id, turn, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]+')) AS n FROM conversations")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.size(tx.wordpunct_tokens(F.col("text"))).cast("long").alias("n"))


@query(
    "bigram_topk",
    f"SELECT bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])) AS bigram FROM (SELECT list_filter({TOK}, lambda x: NOT list_contains({_list(ENGLISH)}, x)) AS ts FROM documents)) GROUP BY bigram ORDER BY n DESC, bigram LIMIT 50",
)
def _(t: Tables) -> DataFrame:
    kept = tx.without(tx.vector_tokens(F.col("text")), ENGLISH)
    return t.documents.select(F.explode(tx.ngrams(kept, 2)).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bigram").limit(50)


@query("normalize_comment", f"SELECT conv_id, turn, {NORM} AS norm FROM conversations")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", tx.normalize_comment(F.col("text")).alias("norm"))


@query("clean_html", f"SELECT page_id, {CLEAN % 'html'} AS clean FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.clean_text(F.col("html")).alias("clean"))


@query("clean_items", f"SELECT page_id, {CLEAN % 'url'} || ' ' || {CLEAN % 'html'} AS text_clean FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.clean_item(F.col("url"), F.col("html")).alias("text_clean"))


@query("fold_accents", "SELECT doc_id, translate(lower(text), 'áéíóúü', 'aeiouu') AS folded FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.fold_accents(F.lower("text")).alias("folded"))


@query("prefix_snippet", "SELECT doc_id, substr(text, 1, 120) AS snippet, CASE WHEN length(text) > 25 THEN substr(text, 1, 25) || '...' ELSE text END AS short FROM documents")
def _(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select("doc_id", tx.prefix(text, 120).alias("snippet"), F.when(F.length(text) > 25, F.concat(tx.prefix(text, 25), F.lit("..."))).otherwise(text).alias("short"))


@query(
    "text_flags",
    rf"""SELECT doc_id, len(list_filter(regexp_extract_all(norm, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^\p{{Nd}}+$'))) > 0 AS has_number,
      contains(text, '!') AS has_exclamation, contains(text, '...') AS has_ellipsis, length(norm) > 120 AS long_120,
      len(list_intersect(string_split(norm, ' '), {_list(NEGATIONS)})) > 0 AS has_negation,
      {" OR ".join(f"starts_with(lower(text), '{h}')" for h in HYPERBOLE)} AS hyperbole
      FROM (SELECT doc_id, text, {NORM} AS norm FROM documents)""",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", tx.normalize_comment(F.col("text")).alias("norm"))
    text, norm = F.col("text"), F.col("norm")
    return rows.select("doc_id", tx.has_number(tx.wordpunct_tokens(norm)).alias("has_number"), text.contains("!").alias("has_exclamation"), text.contains("...").alias("has_ellipsis"), (F.length(norm) > 120).alias("long_120"), tx.has_negation(norm).alias("has_negation"), tx.starts_hyperbolic(text).alias("hyperbole"))


@query(
    "path_parts",
    "SELECT page_id, string_split(url, '/')[-1] AS base, CASE WHEN regexp_matches(string_split(url, '/')[-1], '^.+\\.[^.]*$') THEN regexp_extract(string_split(url, '/')[-1], '^(.+)\\.[^.]*$', 1) ELSE string_split(url, '/')[-1] END AS stem, string_split(url, '/')[-2] AS parent FROM pages",
)
def _(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", tx.basename(u).alias("base"), tx.stem_of_path(u).alias("stem"), tx.parent(u).alias("parent"))


# ---- inverted index and boolean retrieval

_P = f"(SELECT DISTINCT doc_id, unnest({ANALYSED}) AS term FROM documents)"


@query("inverted_index", f"SELECT term, doc_id // 1024 AS block, count(*) AS df, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS postings FROM {_P} GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return index.posting_blocks(t.documents)


@query("bool_and", f"SELECT doc_id FROM {_P} WHERE term IN ('the', 'with', 'this') GROUP BY doc_id HAVING count(*) = 3")
def _(t: Tables) -> DataFrame:
    return index.with_all(index.postings(t.documents), ["the", "with", "this"])


@query("bool_or", f"SELECT doc_id FROM documents WHERE list_has_any({ANALYSED}, ['avec', 'nicht', 'para'])")
def _(t: Tables) -> DataFrame:
    return t.documents.where(index.has_any(index.analysed(F.col("text")), ["avec", "nicht", "para"])).select("doc_id")


@query("bool_not", f"SELECT doc_id FROM documents WHERE list_contains({ANALYSED}, 'the') AND NOT list_contains({ANALYSED}, 'with')")
def _(t: Tables) -> DataFrame:
    ts = index.analysed(F.col("text"))
    return t.documents.where(index.has(ts, "the") & ~index.has(ts, "with")).select("doc_id")


@query("phrase_match", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOK}, ' ') || ' ', ' the apache license ')")
def _(t: Tables) -> DataFrame:
    return t.documents.where(index.phrase(tx.vector_tokens(F.col("text")), ["the", "apache", "license"])).select("doc_id")


_PLACES = "list_filter(list_transform(range(1, len(ts) + 1), lambda i: CASE WHEN ts[i] = '%s' THEN i END), lambda i: i IS NOT NULL)"


@query(
    "near_n",
    f"WITH x AS (SELECT doc_id, {TOK} AS ts FROM documents), y AS (SELECT doc_id, unnest({_PLACES % 'with'}) AS i, {_PLACES % 'from'} AS js FROM x) SELECT DISTINCT doc_id FROM y WHERE len(list_filter(js, lambda j: abs(i - j) <= 5)) > 0",
)
def _(t: Tables) -> DataFrame:
    return t.documents.where(index.near(tx.vector_tokens(F.col("text")), "with", "from", 5)).select("doc_id")


@query(
    "same_sentence",
    f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\\n]+')) AS s FROM documents) WHERE list_contains({_tok('s')}, 'with') AND list_contains({_tok('s')}, 'this')",
)
def _(t: Tables) -> DataFrame:
    return t.documents.where(index.same_sentence(F.col("text"), "with", "this")).select("doc_id")


@query(
    "not_same_sentence",
    f"SELECT doc_id FROM documents WHERE list_contains({TOK}, 'with') AND list_contains({TOK}, 'this') AND doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\\n]+')) AS s FROM documents) WHERE list_contains({_tok('s')}, 'with') AND list_contains({_tok('s')}, 'this'))",
)
def _(t: Tables) -> DataFrame:
    ts = tx.vector_tokens(F.col("text"))
    return t.documents.where(index.has(ts, "with") & index.has(ts, "this") & ~index.same_sentence(F.col("text"), "with", "this")).select("doc_id")


@query("exact_form", r"SELECT doc_id, list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 'the') AS form, list_contains(regexp_extract_all(text, '[\p{L}\p{N}_]+'), 'The') AS cased FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", search.exact(F.col("text"), "The").alias("form"), search.exact(F.col("text"), "The", case=True).alias("cased"))


@query("forced_stopword", f"SELECT doc_id FROM {_P} WHERE term IN ('the', 'license') GROUP BY doc_id HAVING count(*) = 2")
def _(t: Tables) -> DataFrame:
    return index.with_all(index.postings(t.documents), search.kept_terms("+the of license", ENGLISH))


# ---- vector space

_TF = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM d) GROUP BY ALL)"
_IDF = "idf AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM tf GROUP BY term)"
_W = "raw AS (SELECT doc_id, term, tf * idf AS r FROM tf JOIN idf USING (term)), w AS (SELECT doc_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS w FROM raw)"
_ALL = f"d AS (SELECT * FROM documents), {_TF}, {_IDF}"


@query("idf_table", f"WITH {_ALL} SELECT term, df, round(idf, 6) AS idf FROM idf")
def _(t: Tables) -> DataFrame:
    return vsm.idf(vsm.term_counts(t.documents), vsm.number(t.documents)).withColumn("idf", F.round("idf", 6))


@query("vocab_cap", f"WITH {_ALL} SELECT term, sum(tf)::BIGINT AS n FROM tf GROUP BY term ORDER BY n DESC, term LIMIT 100")
def _(t: Tables) -> DataFrame:
    return vsm.cap(vsm.term_counts(t.documents), 100)


@query("tfidf_shape", f"WITH {_ALL} SELECT (SELECT count(*) FROM d) AS n_docs, count(DISTINCT term) AS n_terms, count(*) AS n_weights FROM tf")
def _(t: Tables) -> DataFrame:
    counts = vsm.term_counts(t.documents)
    n = counts.groupBy("term").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("n_terms"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_weights"))
    return t.documents.agg(F.count(F.lit(1)).alias("n_docs")).join(F.broadcast(n))


@query("tfidf_weights", f"WITH {_ALL}, {_W} SELECT doc_id, term, round(w, 6) AS w FROM w")
def _(t: Tables) -> DataFrame:
    return vsm.tfidf(t.documents).withColumn("w", F.round("w", 6))


def _rank_sql(where: str, k: int) -> str:
    return f"""WITH d AS (SELECT * FROM documents {where}), {_TF}, {_IDF}, {_W},
      q0 AS (SELECT term, count(*) * any_value(idf) AS r FROM (SELECT unnest({_tok(f"'{RANKED}'")}) AS term) JOIN idf USING (term) GROUP BY term),
      q AS (SELECT term, r / sqrt(sum(r * r) OVER ()) AS wq FROM q0),
      s AS (SELECT d.doc_id, coalesce(x.s, 0) AS score FROM d LEFT JOIN (SELECT doc_id, sum(w * wq) AS s FROM w JOIN q USING (term) GROUP BY doc_id) x USING (doc_id))
      SELECT doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM s) WHERE rank <= {k}"""


def _ranked(docs: DataFrame, k: int) -> DataFrame:
    return vsm.top(vsm.scores(docs, RANKED), k).withColumn("score", F.round("score", 6))


@query("rank_tfidf_topk", _rank_sql("", 10))
def _(t: Tables) -> DataFrame:
    return _ranked(t.documents, 10)


@query("rank_filtered_topk", _rank_sql("WHERE lang = 'en'", 3))
def _(t: Tables) -> DataFrame:
    # the filter comes first: it changes the document frequencies
    return _ranked(t.documents.where("lang = 'en'"), 3)


@query(
    "pairwise_cosine_sources",
    f"WITH tf AS (SELECT source AS doc_id, term, count(*) AS tf FROM (SELECT source, unnest({TOK}) AS term FROM documents) GROUP BY ALL), d AS (SELECT DISTINCT doc_id FROM tf), {_IDF}, {_W} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, round(sum(a.w * b.w), 6) AS sim FROM w a JOIN w b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL",
)
def _(t: Tables) -> DataFrame:
    # one text for each source: the number of sources bounds what a term joins
    counts = t.documents.select(F.col("source").alias("doc_id"), F.explode(tx.vector_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = counts.agg(F.count_distinct("doc_id").alias("n"))
    return vsm.cosine_pairs(vsm.weights(counts, vsm.idf(counts, n))).withColumn("sim", F.round("sim", 6))


# ---- search predicates

HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1))"
TITLE = CLEAN % "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
BODY = CLEAN % "regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>|<!--.*?-->', ' ', 'g')"


@query("site_search", f"SELECT page_id, {HOST} AS host FROM pages WHERE {HOST} = 'example.com' OR ends_with({HOST}, '.example.com')")
def _(t: Tables) -> DataFrame:
    return t.pages.where(search.site(F.col("url"), "example.com")).select("page_id", search.host(F.col("url")).alias("host"))


@query("hosts", f"SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return t.pages.groupBy(search.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query("filetype", "SELECT page_id, lower(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", search.filetype(F.col("url")).alias("ext"))


@query("intitle", f"SELECT page_id, {TITLE} AS title FROM pages WHERE list_contains(string_split({TITLE}, ' '), 'the') AND list_contains(string_split({TITLE}, ' '), 'of')")
def _(t: Tables) -> DataFrame:
    title = search.title(F.col("html"))
    return t.pages.where(search.all_in(title, ["the", "of"])).select("page_id", title.alias("title"))


@query("inbody", f"SELECT page_id FROM pages WHERE list_contains(string_split({BODY}, ' '), 'with')")
def _(t: Tables) -> DataFrame:
    return t.pages.where(search.all_in(search.body(F.col("html")), ["with"])).select("page_id")


@query("inurl", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'blog')")
def _(t: Tables) -> DataFrame:
    return t.pages.where(search.in_url(F.col("url"), "blog")).select("page_id", "url")


@query("inanchor", f"""SELECT page_id, anchor, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*>(.*?)</a>', 1)) AS a FROM pages), LATERAL (SELECT {CLEAN % "a"} AS anchor) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(search.anchors(F.col("html"))).alias("anchor")).groupBy("page_id", "anchor").agg(F.count(F.lit(1)).alias("n"))


@query("link_targets", """SELECT target, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"', 1)) AS target FROM pages) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return t.pages.select(F.explode(search.links(F.col("html"))).alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("lang_filter", """SELECT page_id FROM pages WHERE regexp_extract(html, '(?is)<html[^>]*\\slang="([^"]*)"', 1) = 'es'""")
def _(t: Tables) -> DataFrame:
    return t.pages.where(search.page_lang(F.col("html")) == "es").select("page_id")


@query("numeric_range", "SELECT page_id FROM pages WHERE len(list_filter(regexp_extract_all(url, '[0-9]+'), lambda x: TRY_CAST(x AS BIGINT) BETWEEN 100 AND 500)) > 0")
def _(t: Tables) -> DataFrame:
    return t.pages.where(search.in_range(F.col("url"), 100, 500)).select("page_id")


@query("wildcard_phrase", rf"SELECT doc_id FROM documents WHERE regexp_matches(' ' || {CLEAN % 'text'} || ' ', ' under \S+ apache license ')")
def _(t: Tables) -> DataFrame:
    return t.documents.where(search.wildcard(F.col("text"), "under * apache license")).select("doc_id")


@query("prefer_boost", f"SELECT page_id, len(list_filter(string_split({BODY}, ' '), lambda x: x = 'the')) + CASE WHEN ends_with({HOST}, '.org') THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM pages")
def _(t: Tables) -> DataFrame:
    hits = F.size(F.filter(F.split(search.body(F.col("html")), " "), lambda x: x == "the"))
    return t.pages.select("page_id", search.prefer(hits.cast("double"), search.host(F.col("url")).endswith(".org"), 10.0).alias("score"))


# ---- naive Bayes on documents and labels


def _nb(t: Tables, stemmed: bool = False):
    stops = lexicon.stop_words("es") if stemmed else ENGLISH
    feats = classify.features(t.documents, stops, stemmed=stemmed)
    labels = t.labels.select("doc_id", F.col("quality").alias("label"))
    return feats, labels


_FEATS = rf"""n AS (SELECT doc_id, text, {NORM} AS norm FROM documents), k AS (SELECT doc_id, text, norm, regexp_extract_all(norm, '[\p{{L}}\p{{N}}_]+') AS ts FROM n),
  f AS (SELECT doc_id, 'HAS_EXCLAMATION' AS fname, contains(text, '!') AS fval FROM k
    UNION ALL SELECT doc_id, 'HAS_NEGATION', len(list_intersect(string_split(norm, ' '), {_list(NEGATIONS)})) > 0 FROM k
    UNION ALL SELECT doc_id, 'LEN_GT_120', length(norm) > 120 FROM k
    UNION ALL SELECT doc_id, 'HAS_NUMBER', true FROM k WHERE len(list_filter(ts, lambda x: regexp_matches(x, '^\p{{Nd}}+$'))) > 0
    UNION ALL SELECT doc_id, 'w=' || unnest(list_distinct(list_filter(ts, lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^\p{{Nd}}+$') AND NOT list_contains({_list(ENGLISH)}, x)))), true FROM k),
  l AS (SELECT doc_id, quality AS label FROM labels), nl AS (SELECT label, count(*) AS n_label FROM l GROUP BY label),
  seen AS (SELECT label, fname, fval, count(*) AS n FROM f JOIN l USING (doc_id) GROUP BY ALL), names AS (SELECT DISTINCT fname FROM seen),
  miss AS (SELECT nl.label, names.fname, NULL::BOOLEAN AS fval, n_label - coalesce(sum(n), 0) AS n FROM nl CROSS JOIN names LEFT JOIN seen ON seen.label = nl.label AND seen.fname = names.fname GROUP BY nl.label, names.fname, n_label HAVING n_label - coalesce(sum(n), 0) > 0),
  e AS (SELECT * FROM seen UNION ALL SELECT * FROM miss), bins AS (SELECT fname, count(DISTINCT coalesce(fval::VARCHAR, 'none')) AS bins FROM e GROUP BY fname),
  tab AS (SELECT nl.label, v.fname, v.fval, coalesce(e.n, 0)::BIGINT AS n, (coalesce(e.n, 0) + 0.5::DOUBLE) / (n_label + 0.5::DOUBLE * bins) AS p FROM (SELECT DISTINCT fname, fval FROM e) v JOIN bins USING (fname) CROSS JOIN nl LEFT JOIN e ON e.label = nl.label AND e.fname = v.fname AND e.fval IS NOT DISTINCT FROM v.fval)"""


@query("nb_train_tables", f"WITH {_FEATS} SELECT label, fname, coalesce(fval::VARCHAR, 'none') AS fval, n, round(p, 9) AS p FROM tab")
def _(t: Tables) -> DataFrame:
    feats, labels = _nb(t)
    table = classify.train(feats, labels)[1]
    return table.select("label", "fname", F.coalesce(F.col("fval").cast("string"), F.lit("none")).alias("fval"), "n", F.round("p", 9).alias("p"))


_PREDICTED = f"""{_FEATS}, pri AS (SELECT label, ln((n_label + 0.5::DOUBLE) / ((SELECT sum(n_label) FROM nl) + 0.5::DOUBLE * (SELECT count(*) FROM nl))) AS lp FROM nl),
  p0 AS (SELECT label, fname, min(0.5::DOUBLE * p / (n + 0.5::DOUBLE)) AS p0 FROM tab GROUP BY ALL),
  ev AS (SELECT f.doc_id, p0.label, sum(ln(coalesce(tab.p, p0.p0))) AS s FROM f JOIN p0 USING (fname) LEFT JOIN tab ON tab.label = p0.label AND tab.fname = f.fname AND tab.fval = f.fval GROUP BY ALL),
  s AS (SELECT d.doc_id, pri.label, pri.lp + coalesce(ev.s, 0) AS s FROM documents d CROSS JOIN pri LEFT JOIN ev ON ev.doc_id = d.doc_id AND ev.label = pri.label),
  x AS (SELECT *, exp(s - max(s) OVER (PARTITION BY doc_id)) AS x FROM s), p AS (SELECT *, x / sum(x) OVER (PARTITION BY doc_id) AS p FROM x),
  predicted AS (SELECT doc_id, label, p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 12) DESC, label DESC) AS r FROM p) WHERE r = 1)"""


@query("nb_predict", f"WITH {_PREDICTED} SELECT doc_id, label, round(p, 6) AS p FROM predicted")
def _(t: Tables) -> DataFrame:
    feats, labels = _nb(t)
    return classify.predict(t.documents, feats, classify.train(feats, labels)).withColumn("p", F.round("p", 6))


@query("score_table", f"WITH {_PREDICTED} SELECT text AS texto, CASE WHEN label = 1 THEN 'good' ELSE 'bad' END AS prediccion, printf('%.2f', p) AS confianza FROM predicted JOIN documents USING (doc_id)")
def _(t: Tables) -> DataFrame:
    feats, labels = _nb(t)
    return classify.score_table(t.documents, classify.predict(t.documents, feats, classify.train(feats, labels)), {0: "bad", 1: "good"})


def _events_sql(kind: str) -> str:
    p = {"multinomial": "ln((coalesce(s.n, 0) + 1)::DOUBLE / (mass + (SELECT count(*) FROM v))) AS yes, 0 AS no", "bernoulli": "ln((coalesce(s.n, 0) + 1)::DOUBLE / (n_label + 2)) AS yes, ln(1 - (coalesce(s.n, 0) + 1)::DOUBLE / (n_label + 2)) AS no"}[kind]
    n, w = ("sum(tf)", "tf * yes") if kind == "multinomial" else ("count(*)", "yes - no")
    return f"""WITH c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY ALL), l AS (SELECT doc_id, quality AS label FROM labels WHERE quality IS NOT NULL), nl AS (SELECT label, count(*) AS n_label FROM l GROUP BY label),
  s AS (SELECT label, term, {n} AS n FROM c JOIN l USING (doc_id) GROUP BY ALL), v AS (SELECT DISTINCT term FROM s), m AS (SELECT label, sum(n) AS mass FROM s GROUP BY label),
  p AS (SELECT nl.label, v.term, {p} FROM nl JOIN m USING (label) CROSS JOIN v LEFT JOIN s ON s.label = nl.label AND s.term = v.term), base AS (SELECT label, sum(no) AS base FROM p GROUP BY label),
  e AS (SELECT doc_id, label, sum({w}) AS e FROM c JOIN p USING (term) GROUP BY ALL),
  x AS (SELECT d.doc_id, nl.label, ln(n_label::DOUBLE / (SELECT sum(n_label) FROM nl)) + base + coalesce(e, 0) AS s FROM documents d CROSS JOIN nl JOIN base USING (label) LEFT JOIN e ON e.doc_id = d.doc_id AND e.label = nl.label)
  SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, label) AS r FROM x) WHERE r = 1"""


def _events(kind: str):
    @query(f"{kind}_nb", _events_sql(kind))
    def _(t: Tables) -> DataFrame:
        counts = learners.checkpointed(vsm.term_counts(t.documents))
        model = classify.train_events(counts, t.labels.select("doc_id", F.col("quality").alias("label")), kind)
        return classify.predict_events(t.documents, counts, model, kind)


for _kind in ("multinomial", "bernoulli"):
    _events(_kind)


@query("nb_predict_stemmed")
def _(t: Tables) -> DataFrame:
    feats, labels = _nb(t, stemmed=True)
    return classify.predict(t.documents, feats, classify.train(feats, labels))


@query("sarcasm_features")
def _(t: Tables) -> DataFrame:
    return classify.features(t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text"), lexicon.stop_words("es"), sarcasm=True).groupBy("fname", "fval").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sarcasm_features_plain",
    rf"""WITH n AS (SELECT coalesce(text, '') AS raw, {NORM} AS norm FROM conversations), f AS (SELECT 'HAS_EXCLAMATION' AS fname, contains(raw, '!') AS fval FROM n UNION ALL SELECT 'HAS_ELLIPSIS', contains(raw, '...') FROM n UNION ALL SELECT 'LONG_TEXT', length(norm) > 100 FROM n
    UNION ALL SELECT 'HYPERBOLE_START', {' OR '.join(f"starts_with(lower(raw), '{w}')" for w in HYPERBOLE)} FROM n UNION ALL SELECT 'w=' || unnest(list_distinct(list_filter(regexp_extract_all(norm, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2 AND NOT list_contains({_list(INLINE_STOP_WORDS)}, x)))), true FROM n)
    SELECT fname, fval, count(*) AS n FROM f GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    feats = classify.features(t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text"), INLINE_STOP_WORDS, stemmed=False, sarcasm=True)
    return feats.groupBy("fname", "fval").agg(F.count(F.lit(1)).alias("n"))


def _predictor(feats: DataFrame):
    def predict(known: DataFrame, rest: DataFrame) -> DataFrame:
        own = feats.join(rest, "doc_id", "left_semi")
        return classify.predict(rest, own, classify.train(feats, known.select("doc_id", "label")))

    return predict


@query("self_training")
def _(t: Tables) -> DataFrame:
    feats, labels = _nb(t)
    feats = learners.checkpointed(feats)
    return learners.self_training(labels, t.documents.join(labels, "doc_id", "left_anti"), _predictor(feats), 0.95, 2)


@query("co_training")
def _(t: Tables) -> DataFrame:
    feats, labels = _nb(t)
    feats = learners.checkpointed(feats)
    words = F.col("fname").startswith("w=")
    return learners.co_training(labels, t.documents.join(labels, "doc_id", "left_anti"), (_predictor(feats.where(words)), _predictor(feats.where(~words))), 0.9, 1)
