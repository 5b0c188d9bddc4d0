from pyspark.sql import functions as F

from corvina.functions import text as tx
from corvina.sources import feeds


def test_references_are_decoded(spark):
    cases = {
        "a &amp; b": "a & b",
        "caf&#233; &#xE9;&#x1F600;": "café é\U0001F600",
        "&lt;p&gt; &quot;x&quot; &apos;": "<p> \"x\" '",
        "&amp;lt; &amp;#38; &#38;lt;": "&lt; &#38; &lt;",
        "&unknown; & &#; plain": "&unknown; & &#; plain",
        "": "",
        None: None,
    }
    d = spark.createDataFrame(list(cases.items()), "raw string, want string")
    assert [(r["got"], r["want"]) for r in d.select(tx.unescape(F.col("raw")).alias("got"), "want").where("not (got <=> want)").collect()] == []


def test_feed_texts(spark):
    body = """<?xml version="1.0"?><rss><channel><title>News &amp; more</title>
    <item><title>Se&#241;al &amp; ruido</title><link>http://x/?a=1&amp;b=2</link><description><![CDATA[<p>raw &amp; kept</p>]]></description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>
    <item><title><![CDATA[A &amp; B]]></title><summary>&lt;b&gt;bold&lt;/b&gt; text</summary></item></channel></rss>"""
    got = feeds.items(spark.createDataFrame([("u", body), ("v", "no feed"), ("w", None)], "url string, body string")).orderBy(F.col("source").isNull(), "pos", "url").collect()
    assert [(r["source"], r["title"], r["link"], r["summary"]) for r in got[:2]] == [("News & more", "Señal & ruido", "http://x/?a=1&b=2", "<p>raw &amp; kept</p>"), ("News & more", "A &amp; B", "", "<b>bold</b> text")]
    assert [(r["url"], r["error"]) for r in got[2:]] == [("v", "not a feed"), ("w", "not a feed")]
