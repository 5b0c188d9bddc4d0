"""Spanish stemmer after the published Snowball description, as an Arrow-backed UDF."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = frozenset("aeiouáéíóúü")
_PLAIN = str.maketrans("áéíóú", "aeiou")

# Fixed values of the published algorithm: suffix lists by step.
_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_GERUNDS = "iéndo ándo ár ér ír".split()
_GERUNDS_PLAIN = "iendo ando ar er ir".split()
_DELETE = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_DELETE_IC = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
_REPLACE = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
_Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_VERBS_GU = "en es éis emos".split()
_VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais "
    "aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
_RESIDUAL = "os a o á í ó".split()


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _after_vowel_consonant(word: str, start: int) -> int:
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _rv(w: str) -> int:
    if len(w) < 2:
        return len(w)
    if w[1] not in _VOWELS:
        return next((i + 1 for i in range(2, len(w)) if w[i] in _VOWELS), len(w))
    if w[0] in _VOWELS:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in _VOWELS), len(w))
    return min(3, len(w))


def stem(word: str) -> str:
    w = word.lower()
    rv, r1 = _rv(w), _after_vowel_consonant(w, 0)
    r2 = _after_vowel_consonant(w, r1) if r1 < len(w) else len(w)
    inside = lambda s, region: len(w) - len(s) >= region

    # attached pronoun
    s = _longest(w, _PRONOUNS)
    if s and inside(s, rv):
        base = w[: -len(s)]
        before = _longest(base, _GERUNDS)
        plain = _longest(base, _GERUNDS_PLAIN)
        if before and len(base) - len(before) >= rv:
            w = base[: -len(before)] + before.translate(_PLAIN)
        elif plain and len(base) - len(plain) >= rv or base.endswith("yendo") and len(base) - 5 >= rv and base[-6:-5] == "u":
            w = base

    # standard suffix
    start = w
    s = _longest(w, [*_DELETE, *_DELETE_IC, *_REPLACE, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"])
    if s == "amente" and inside(s, r1):
        w = w[:-6]
        if w.endswith("iv") and inside("iv", r2):
            w = w[:-2]
            if w.endswith("at") and inside("at", r2):
                w = w[:-2]
        else:
            t = _longest(w, ("os", "ic", "ad"))
            if t and inside(t, r2):
                w = w[: -len(t)]
    elif s and s != "amente" and inside(s, r2):
        w = w[: -len(s)] + _REPLACE.get(s, "")
        more = {**dict.fromkeys(_DELETE_IC, ("ic",)), "mente": ("ante", "able", "ible"), **dict.fromkeys(("idad", "idades"), ("abil", "ic", "iv")), **dict.fromkeys(("iva", "ivo", "ivas", "ivos"), ("at",))}.get(s, ())
        t = _longest(w, more)
        if t and inside(t, r2):
            w = w[: -len(t)]

    if w == start:
        # verb suffixes
        s = _longest(w, [x for x in _Y_VERBS if inside(x, rv)])
        if s and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            s = _longest(w, [x for x in (*_VERBS, *_VERBS_GU) if inside(x, rv)])
            if s:
                w = w[: -len(s)]
                if s in _VERBS_GU and w.endswith("gu"):
                    w = w[:-1]

    # residual suffix
    s = _longest(w, _RESIDUAL)
    if s and inside(s, rv):
        w = w[: -len(s)]
    elif w[-1:] in ("e", "é") and inside("e", rv):
        w = w[:-1]
        if w.endswith("gu") and inside("u", rv):
            w = w[:-1]
    return w.translate(_PLAIN)


class _Memo(dict):
    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[word] = s = stem(word)
        return s


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    memo = _Memo()
    for batch in batches:
        yield pd.Series([[memo[t] for t in ts] if ts is not None else None for ts in batch], dtype=object)


def stems(tokens: Column) -> Column:
    """Stem of each token of an array; the only function here that leaves the JVM, in Arrow batches."""
    return _stems(tokens)
