"""Text functions as Column expressions; nothing here leaves the JVM.

Character classes are spelled out, as ``\\w`` isn't Unicode-aware in Java
unless asked, and differs between engines when it is.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvina.functions.lexicon import HYPERBOLE, NEGATIONS

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}]"
NOT_SPACE = r"[^\s\p{Z}]"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def lower(text: Column) -> Column:
    return F.lower(text)


def index_analysis(text: Column) -> Column:
    """Lower case without full stops, colons and commas."""
    return F.regexp_replace(F.lower(text), "[.:,]", "")


def split_words(text: Column) -> Column:
    """Maximal runs without white space."""
    return _all(text, NOT_SPACE + "+")


def clean_text(text: Column) -> Column:
    """Tags and punctuation become spaces, white space is collapsed and trimmed, case folded; null is empty."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    bare = F.regexp_replace(bare, r"[^\p{L}\p{N}_\s\p{Z}]", " ")
    return F.lower(F.trim(F.regexp_replace(bare, SPACE + "+", " ")))


def clean_item(title: Column, summary: Column) -> Column:
    """Both cleaned, one space between even if one is empty."""
    return F.concat(clean_text(title), F.lit(" "), clean_text(summary))


def normalize_comment(text: Column) -> Column:
    """Lower case; links, mentions, hashtags and everything but Spanish letters, digits and spaces become spaces. The order matters."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}+|{SPACE}+$", ""))
    for pattern in (rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+", rf"@{WORD}+", rf"#{WORD}+", r"[^a-záéíóúñü0-9\s\p{Z}]"):
        t = F.regexp_replace(t, pattern, " ")
    return F.trim(F.regexp_replace(t, SPACE + "+", " "))


def word_tokens(text: Column) -> Column:
    """Words, and each punctuation mark as a token."""
    return _all(text, rf"{WORD}+|[^\p{{L}}\p{{N}}_\s\p{{Z}}]")


def wordpunct_tokens(text: Column) -> Column:
    """Words, and runs of punctuation."""
    return _all(text, rf"{WORD}+|[^\p{{L}}\p{{N}}_\s\p{{Z}}]+")


def vector_tokens(text: Column) -> Column:
    """Lower-case words of two characters or more."""
    return _all(F.lower(text), WORD + "{2,}")


def alphabetic(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(r"^\p{L}+$"))


def without(tokens: Column, words: Iterable[str]) -> Column:
    """Tokens that aren't in the list; repeats stay."""
    listed = list(words)  # as a set of literals, which is looked up by hash
    return F.filter(tokens, lambda t: ~t.isin(listed)) if listed else tokens


def at_least(tokens: Column, n: int) -> Column:
    return F.filter(tokens, lambda t: F.length(t) >= n)


def is_number(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}+$")


def has_number(tokens: Column) -> Column:
    return F.exists(tokens, is_number)


def has_negation(normalized: Column) -> Column:
    return F.arrays_overlap(F.split(normalized, " "), F.array(*(F.lit(w) for w in NEGATIONS)))


def starts_hyperbolic(text: Column) -> Column:
    t, out = F.lower(text), F.lit(False)
    for phrase in HYPERBOLE:
        out = out | t.startswith(phrase)
    return out


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined runs of n tokens."""
    # elements by place: a slice would copy the whole array each time
    several = lambda ts: F.transform(F.sequence(F.lit(0), F.size(ts) - n), lambda i: F.concat_ws(" ", *(F.get(ts, i + k) for k in range(n))))
    return let(tokens, lambda ts: F.when(F.size(ts) >= n, several(ts)).otherwise(F.array().cast("array<string>")))


def fold_accents(text: Column) -> Column:
    return F.translate(text, "áéíóúü", "aeiouu")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem_of_path(path: Column) -> Column:
    """File name without its last extension."""
    name = basename(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def parent(path: Column) -> Column:
    """Name of the folder."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(F.lit(""))


def bits_to_character(bits: Column) -> Column:
    """Eight bits, highest first, as text of 0 and 1."""
    return F.chr(F.conv(bits, 2, 10).cast("int"))


def up_to_terminator(message: Column, terminator: str = "###FIN###") -> Column:
    """The message up to the terminator, which stays; all of it if there is none."""
    at = F.instr(message, terminator)
    return F.when(at > 0, F.substring(message, F.lit(1), at + len(terminator) - 1)).otherwise(message)


def prefix(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def unescape(text: Column) -> Column:
    """Text of XML with its character references decoded: the named ones of the standard, and numbers."""
    references = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0)))
    digits = lambda r: F.when(F.lower(F.substring(r, 3, 1)) == "x", F.regexp_replace(r, "[&#;xX]", "")).otherwise(F.conv(F.regexp_replace(r, "[&#;]", ""), 10, 16))
    character = lambda r: F.decode(F.unhex(F.lpad(digits(r), 8, "0")), "UTF-32")
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(value))
    text = F.aggregate(references, text, lambda t, r: F.replace(t, r, character(r)))
    # last, so that nothing is decoded twice
    return F.replace(text, F.lit("&amp;"), F.lit("&"))
