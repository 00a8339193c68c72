"""Search keys: exact (trimmed, composed, lower-cased) and loose (folded for a language)."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: ASCII punctuation and white space, which loose keys leave out.
DROPPED = r"(?U)[!-/:-@\[-`{-~]|\s"


#: Characters with the property White_Space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(s: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.trim(s, F.lit(BLANKS))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; the one function that the JVM side lacks."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(ArrayType(StringType()))
def nfc_each(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFC", x) for x in xs])


@cache
def _decompositions() -> tuple[str, str]:
    """Characters that decompose to one character and marks, and those characters."""
    src, dst = [], []
    for i in range(0xC0, 0x30000):
        if 0xAC00 <= i < 0xE000:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(i)) if unicodedata.category(c)[0] != "M")
        if len(plain) == 1 and plain != chr(i):
            src.append(chr(i))
            dst.append(plain)
    return "".join(src), "".join(dst)


def strip_marks(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, *_decompositions()), r"\p{M}", "")


def fold_standalone(s: Column) -> Column:
    """Letters that no decomposition reaches."""
    for a, b in (("œ", "oe"), ("æ", "ae"), ("ß", "ss"), ("þ", "th")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.translate(s, "øðđłı", "oddli")


def _drop(s: Column) -> Column:
    return F.regexp_replace(s, DROPPED, "")


def _replaced(s: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def loose_generic(s: Column) -> Column:
    """Marks stripped, lone letters folded; ASCII, which has neither, skips the tables."""
    return _drop(F.when(s.rlike(r"[^\x00-\x7F]"), fold_standalone(strip_marks(s))).otherwise(s))


#: Loose folding by language, of an exact key; other languages fold generically.
LOOSE = {
    "es": lambda s: _drop(F.translate(s, "áéíóúü", "aeiouu")),
    "ca": lambda s: _drop(F.translate(_replaced(s, ("l·l", "ll"), ("l.l", "ll"), ("l•l", "ll")), "àéèíïóòúüç", "aeeiioouuc")),
    "de": lambda s: _drop(F.translate(_replaced(s, ("ß", "ss")), "äöü", "aou")),
    "fr": lambda s: _drop(F.translate(_replaced(s, ("œ", "oe"), ("æ", "ae")), "éèêëàâîïôùûüç", "eeeeaaiiouuuc")),
    "ar": lambda s: _drop(F.translate(F.regexp_replace(strip_marks(s), "[ً-ٰٟ]", ""), "أإآٱةى", "ااااهي")),
    "zh": lambda s: _drop(F.translate(s, "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜü", "aaaaeeeeiiiioooouuuuuuuuu")),
}
LOOSE |= {"ary": LOOSE["ar"], "cmn": LOOSE["zh"]}


def loose_key(exact: Column, language: Column | str) -> Column:
    """The loose key of an exact key; by a language, or by a column of languages."""
    if isinstance(language, str):
        return LOOSE.get(language, loose_generic)(exact)
    out = loose_generic(exact)
    for name, fold in LOOSE.items():
        out = F.when(language == name, fold(exact)).otherwise(out)
    return out


def exact_key(s: Column, composed: bool = False) -> Column:
    """``composed``: the source is known to be in NFC, so that no Python runs."""
    s = trim(s)
    return F.lower(s if composed else nfc(s))


def exact_keys(texts: Column, composed: bool = False) -> Column:
    """``exact_key`` of each text of an array."""
    texts = F.transform(texts, trim)
    return F.transform(texts if composed else nfc_each(texts), F.lower)
