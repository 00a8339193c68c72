"""Tokens and text functions of the lookup surface; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import BLANKS


def tokenize(s: Column, letters: str = r"\p{IsAlphabetic}\p{N}") -> Column:
    """Words of letters, digits, ' and -; longer than one character before those are trimmed."""
    words = F.filter(F.split(s, f"[^{letters}'-]+"), lambda w: F.char_length(w) > 1)
    return F.filter(F.transform(words, lambda w: F.lower(F.trim(w, F.lit("'-")))), lambda w: w != "")


def fts_tokens(s: Column, letters: str = r"\p{IsAlphabetic}\p{N}\p{M}") -> Column:
    return F.filter(F.split(F.lower(s), f"[^{letters}]+"), lambda w: w != "")


def edge_strip(s: Column) -> Column:
    """Blanks collapsed, punctuation and symbols other than - off the ends, 200 characters at most."""
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    s = F.regexp_replace(s, r"(?U)^[\p{P}\p{S}\s&&[^-]]+", "")
    s = F.substring(F.regexp_replace(s, r"(?U)[\p{P}\p{S}\s&&[^-]]+$", ""), 1, 200)
    return F.regexp_replace(s, r"(?U)\s+$", "")


def lookup_label(s: Column) -> Column:
    """A menu label; the text in it is cut to 40 characters."""
    shown = F.when(F.char_length(s) > 40, F.concat(F.substring(s, 1, 39), F.lit("…"))).otherwise(s)
    return F.concat(F.lit("Look up “"), shown, F.lit("”"))


def escape_menu_label(s: Column) -> Column:
    return F.replace(s, F.lit("&"), F.lit("&&"))


def relation_word(s: Column) -> Column:
    return F.rtrim(s, F.lit("(（," + BLANKS))


def word_at(text: Column, offset: Column) -> Column:
    """The word of letters, marks, digits, ', ’ and · around a code-point offset; null between words."""
    inside = r"\p{L}\p{M}\p{N}'’·"
    left = F.regexp_extract(F.substr(text, F.lit(1), offset), f"([{inside}]*)$", 1)
    right = F.regexp_extract(F.substr(text, offset + 1), f"^([{inside}]*)", 1)
    return F.nullif(F.concat(left, right), F.lit(""))


def has_han(s: Column) -> Column:
    return s.rlike("[\\u4E00-\\u9FFF]")


def display_forms(forms: Column, lemma: Column) -> Column:
    """Forms worth showing: not the lemma, of a kind of their own, each spelling once, in order."""
    kept = F.filter(forms, lambda f: (F.coalesce(f["form"], F.lit("")) != "") & (f["form"] != lemma) & ~F.lower(F.coalesce(f["type"], F.lit(""))).isin("", "form", "canonical"))
    spelled = F.transform(kept, lambda f: f["form"])
    return F.filter(kept, lambda f, i: F.array_position(spelled, f["form"]) == i + 1)


def spoken(pronunciations: Column) -> Column:
    return F.filter(pronunciations, lambda p: F.coalesce(p["ipa"], F.lit("")) != "")


def recordings(pronunciations: Column) -> Column:
    return F.filter(pronunciations, lambda p: F.coalesce(p["audio"], F.lit("")) != "")


#: The voices of speech requests by language. Synthesis needs a network and is left out.
VOICES = {
    "en": "en-US-JennyNeural",
    "ca": "ca-ES-JoanaNeural",
    "es": "es-ES-AlvaroNeural",
    "fr": "fr-FR-DeniseNeural",
    "de": "de-DE-KatjaNeural",
    "ary": "ar-MA-MounaNeural",
    "ar": "ar-MA-MounaNeural",
    "zh": "zh-CN-XiaoxiaoNeural",
    "cmn": "zh-CN-XiaoxiaoNeural",
}


def voice_for(lang: Column) -> Column:
    """The voice of a language; null if it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in VOICES.items() for x in kv)), lang)


def xml_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def speech_text(s: Column) -> Column:
    """The first 600 characters, escaped."""
    return xml_escape(F.substring(s, 1, 600))


def speech_token(seconds: Column, secret: str) -> Column:
    """Upper-case SHA-256 of the five minutes a Unix time lies in, as 100 ns since 1601, and a secret."""
    ticks = seconds.cast("long") + 11_644_473_600
    return F.upper(F.sha2(F.concat(((ticks - ticks % 300) * 10_000_000).cast("string"), F.lit(secret)), 256))


def speech_time(seconds: Column) -> Column:
    """A Unix time in words, in UTC whatever the session's zone."""
    utc = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return F.date_format(utc, "EEE MMM dd yyyy HH:mm:ss 'GMT+0000 (Coordinated Universal Time)'")
