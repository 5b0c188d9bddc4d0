"""Search-engine style predicates over pages(url, html) and documents(text, lang)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvina.functions import text as tx


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def site(url: Column, domain: str) -> Column:
    """Host is the domain or below it."""
    return (host(url) == domain) | host(url).endswith("." + domain)


def hostname(url: Column, name: str) -> Column:
    return host(url) == name


def filetype(url: Column) -> Column:
    """Extension of the path's last part, in lower case; empty if none."""
    return F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))


def title(html: Column) -> Column:
    return tx.clean_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def body(html: Column) -> Column:
    """Text without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>|<!--.*?-->", " ")
    return tx.clean_text(bare)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="([^"]*)"'), F.lit(1))


def anchors(html: Column) -> Column:
    """Cleaned text of each link."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*>(.*?)</a>"), F.lit(1)), tx.clean_text)


def all_in(cleaned: Column, terms: list[str]) -> Column:
    words = F.split(cleaned, " ")
    out = F.lit(True)
    for t in terms:
        out = out & F.array_contains(words, t)
    return out


def in_url(url: Column, part: str) -> Column:
    return F.lower(url).contains(part.lower())


def page_lang(html: Column) -> Column:
    return F.regexp_extract(html, r'(?is)<html[^>]*\slang="([^"]*)"', 1)


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0)), lambda x: x.try_cast("bigint"))


def in_range(text: Column, low: int, high: int) -> Column:
    return F.exists(numbers(text), lambda n: n.between(low, high))


def wildcard(text: Column, pattern: str) -> Column:
    """Phrase in which ``*`` stands for one word."""
    words = [r"\S+" if w == "*" else re.escape(w.lower()) for w in pattern.split()]
    return F.concat(F.lit(" "), tx.clean_text(text), F.lit(" ")).rlike(" " + " ".join(words) + " ")


def exact(text: Column, word: str, case: bool = False) -> Column:
    """The word in this very form, with its case if asked."""
    tokens = F.regexp_extract_all(text if case else F.lower(text), F.lit(tx.WORD + "+"), F.lit(0))
    return F.array_contains(tokens, word if case else word.lower())


def kept_terms(query: str, stops: list[str]) -> list[str]:
    """Terms of a query without stop words, except those forced by a plus sign."""
    return [w.lstrip("+") for w in query.lower().split() if w.startswith("+") or w not in set(stops)]


def prefer(score: Column, condition: Column, boost: float) -> Column:
    return score + F.when(condition, F.lit(float(boost))).otherwise(0.0)


def on_date(when: Column, first: str, last: str | None = None) -> Column:
    """On a day, or from one day to another, both included (yyyy-mm-dd). As bounds of the column itself they reach the scan."""
    return (when >= F.lit(first).cast("date")) & (when < F.date_add(F.lit(last or first).cast("date"), 1))
