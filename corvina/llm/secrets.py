"""Secret scans.

An Aho-Corasick automaton over the keywords of all rules runs once over each
text; a rule's regular expression is tried, anchored, only where one of its
keywords begins. Token kinds that carry a checksum or an encoded header are
kept only if it verifies. Long hexadecimal runs have no keyword, so they come
from one class-run scan. Where an expression fails after a long run of
characters, later keywords within that run can't do better and are passed
over, so the time is linear in the length of the text.

Defined results: null and empty texts have no spans; offsets are code points,
end exclusive; repeated rows are scanned independently; no length limit.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Base kinds first; spans with one start are listed in this order.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]+")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,64}?PRIVATE KEY)-----([A-Za-z0-9+/=\s]++)-----END \1-----")
#: A part of a web token. A token begins at the first keyword of its run: what follows the run is the same for all others in it.
_RUN = re.compile(r"[A-Za-z0-9_-]+")

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out.rjust(width, "0")


def checksummed(token: str) -> bool:
    """The last 6 characters of the token's body are the base-62 CRC-32 of the 30 before."""
    body = token.split("_", 1)[1]
    return base62(zlib.crc32(body[:-6].encode()), 6) == body[-6:]


def _json_part(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error):
        return False


def _der(body: str) -> bool:
    try:
        raw = base64.b64decode("".join(body.split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    return raw[:1] == b"\x30" or raw[:14] == b"openssh-key-v1"


#: kind -> (keywords in lower case, case matters, expression, test of a match)
RULES = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), _ASSIGN, lambda m: len(m[2]) >= 8),
    "access": (("akia",), _ACCESS, lambda m: len(m[0]) >= 16),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _GITHUB, lambda m: checksummed(m[0])),
    "npm": (("npm_",), _NPM, lambda m: checksummed(m[0])),
    "jwt": (("eyj",), _JWT, lambda m: _json_part(m[1]) and _json_part(m[2])),
    "pem": (("-----begin ",), _PEM, lambda m: _der(m[2])),
}
_automaton = None

SCANNED = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in BASE), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.StringType()))])


def automaton():
    """Keyword automaton, built once per Python worker."""
    global _automaton
    if _automaton is None:
        a = ahocorasick.Automaton()
        for kind, (words, _, _) in RULES.items():
            for w in words:
                a.add_word(w, (kind, len(w)))
        a.make_automaton()
        _automaton = a
    return _automaton


def find(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, by start and then kind as in KINDS."""
    if not text:
        return []
    # bytes.lower() touches A-Z only, so code points keep their places
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits = [(end + 1 - size, kind) for end, (kind, size) in automaton().iter(low)]
    found = [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    if hits:
        done = dict.fromkeys(KINDS, 0)
        for start, kind in sorted(hits):
            if start < done[kind]:
                continue
            _, pattern, holds = RULES[kind]
            m = pattern.match(text, start)
            if m:
                # what fails its test was still consumed: matches don't overlap
                done[kind] = m.end()
                if holds(m):
                    found.append((start, kind, m.end()))
                elif kind == "jwt":  # a token may begin with what was taken for the second part
                    done[kind] = m.start(2)
            elif kind == "jwt":
                done[kind] = _RUN.match(text, start).end()
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def redact(text: str | None, mask: str = "[{kind}]") -> str | None:
    """The text with every span replaced by the mask; overlapping spans become one, named by the first."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for start, kind, end in spans:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([start, kind, end])
    for start, kind, end in merged:
        out += [text[at:start], mask.format(kind=kind)]
        at = end
    return "".join([*out, text[at:]])


@F.pandas_udf(SCANNED)
def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch:
            spans = find(text)
            base = [s for s in spans if s[1] in BASE]
            digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
            rows.append((*(sum(s[1] == k for s in base) for k in BASE), digest, [f"{k}:{a}:{b}" for a, k, b in spans]))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


@F.pandas_udf(T.StringType())
def _redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([redact(t) for t in batch], dtype=object)


def scan(text: Column) -> Column:
    """Struct of counts by base kind, digest of the base spans, and all spans as ``kind:start:end``."""
    return _scan(text)


def redacted(text: Column) -> Column:
    """The text with its secrets masked; null stays null."""
    return _redacted(text)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans (array) for each row of ``docs``; one pass, no shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col)).alias("_s")).select("doc_id", "_s.*")
