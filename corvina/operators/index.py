"""Inverted index and boolean, phrase and proximity predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.functions import text as tx

#: Documents of one block of a posting list.
BLOCK = 1024


def analysed(text: Column) -> Column:
    return tx.split_words(tx.index_analysis(text))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc_id once each: the working layout, in which no list is ever gathered."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(analysed(F.col(text_col)))).alias("term"))


def posting_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, block, df, postings: ids in order, in blocks of BLOCK ids, so that a frequent term's list has a bound."""
    p = postings(docs, id_col, text_col).withColumn("block", F.floor(F.col("doc_id") / BLOCK))
    return p.groupBy("term", "block").agg(F.count(F.lit(1)).alias("df"), F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("postings"))


def posting_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, postings as one array: for small corpora."""
    return postings(docs, id_col, text_col).groupBy("term").agg(F.sort_array(F.collect_set("doc_id")).alias("postings"))


def with_all(p: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id of documents in the postings of every term."""
    terms = sorted(set(terms))
    return p.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms)).select("doc_id")


def has(tokens: Column, term: str) -> Column:
    return F.array_contains(tokens, term)


def has_any(tokens: Column, terms: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*(F.lit(t) for t in terms)))


def phrase(tokens: Column, terms: list[str]) -> Column:
    """The terms follow each other. Padded text, so that a term only matches whole tokens."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(" " + " ".join(terms) + " ")


def near(tokens: Column, a: str, b: str, n: int) -> Column:
    """Some a and some b are at most n places apart, in any order."""
    places = lambda ts, t: F.filter(F.transform(ts, lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull())
    close = lambda left, right: F.exists(left, lambda i: F.exists(right, lambda j: F.abs(i - j) <= n))
    return tx.let(tokens, lambda ts: tx.let(places(ts, a), lambda left: tx.let(places(ts, b), lambda right: close(left, right))))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s) != "")


def same_sentence(text: Column, a: str, b: str) -> Column:
    return F.exists(sentences(text), lambda s: tx.let(tx.vector_tokens(s), lambda ts: has(ts, a) & has(ts, b)))
