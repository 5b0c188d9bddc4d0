"""News feeds (RSS and Atom) from files or from given texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.functions import text as tx

ITEM = "title string, link string, published string, pubDate string, updated string, summary string, description string"
SCHEMA = "source string, title string, link string, published string, summary string, error string, url string, pos int"


def items(feeds: DataFrame, max_entries: int = 20) -> DataFrame:
    """Rows of SCHEMA from (url, body): the first entries of each feed, or one row with an error.

    ``published`` falls back to the date of the last update and ``summary`` to
    the description, if absent; a present empty value stays. The source is the
    feed's title, else its url.
    """
    # elements of the two feed formats, in the order of the file; namespaces' prefixes are ignored
    entry = F.regexp_extract_all("body", F.lit(r"(?s)<(?:item|entry)[\s>].*?</(?:item|entry)>"), F.lit(0))

    def field(x, *names):
        def text(n):
            plain = tx.unescape(F.regexp_extract(x, rf"(?s)<{n}(?:\s[^>]*)?>\s*(.*?)\s*</{n}>", 1))
            marked = rf"(?s)<{n}(?:\s[^>]*)?>\s*<!\[CDATA\[(.*?)\]\]>\s*</{n}>"
            # marked sections hold no references
            return F.when(x.rlike(marked), F.regexp_extract(x, marked, 1)).otherwise(plain)

        return F.coalesce(*(F.when(x.rlike(rf"(?s)<{n}(?:\s[^>]*)?>.*?</{n}>"), text(n)) for n in names))

    good = F.col("body").isNotNull() & F.col("body").rlike(r"(?s)<(?:rss|feed|rdf:RDF)[\s>]")
    channel = F.regexp_replace("body", r"(?s)<(?:item|entry)[\s>].*?</(?:item|entry)>", "")
    rows = feeds.withColumn("good", F.coalesce(good, F.lit(False)))
    parsed = rows.where("good").select(F.coalesce(field(channel, "title"), F.col("url")).alias("source"), F.posexplode(F.slice(entry, 1, max_entries)).alias("pos", "x"))
    link = F.coalesce(field(F.col("x"), "link"), F.nullif(tx.unescape(F.regexp_extract("x", r'<link[^>]*href="([^"]*)"', 1)), F.lit("")))
    parsed = parsed.select(
        "source",
        F.coalesce(field(F.col("x"), "title"), F.lit("")).alias("title"),
        F.coalesce(link, F.lit("")).alias("link"),
        field(F.col("x"), "pubDate", "published", "dc:date", "updated").alias("published"),
        field(F.col("x"), "summary", "description").alias("summary"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("url"),
        "pos",
    )
    none = lambda c: F.lit(None).cast("string").alias(c)
    failed = rows.where("not good").select(*(none(c) for c in ("source", "title", "link", "published", "summary")), F.lit("not a feed").alias("error"), "url", F.lit(0).alias("pos"))
    return parsed.unionByName(failed)


def with_clean_text(rows: DataFrame) -> DataFrame:
    """Adds text_clean; rows with an error keep it null."""
    return rows.withColumn("text_clean", F.when(F.col("error").isNull(), tx.clean_item(F.col("title"), F.col("summary"))))


def first_entries(rows: DataFrame, n: int, order: str = "pos") -> DataFrame:
    r = F.row_number().over(Window.partitionBy("source").orderBy(order))
    return rows.withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def from_files(spark: SparkSession, path: str, max_entries: int = 20) -> DataFrame:
    feeds = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("body"))
    return items(feeds, max_entries)


def timestamp(published):
    """Time of the usual forms of feed dates; null if none fits."""
    rfc = F.regexp_replace(F.regexp_replace(published, "GMT$", "+0000"), r"^\w{3}, ", "")
    iso = F.regexp_replace(published, "-00:00$", "+00:00")
    return F.coalesce(F.try_to_timestamp(rfc, F.lit("dd MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(iso))
