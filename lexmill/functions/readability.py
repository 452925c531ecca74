"""Readability and jargon columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import WS, collapsed, trimmed

# Terms that need an explanation.
JARGON = (
    "hereinafter", "heretofore", "thereof", "therein", "hereby", "whereas", "aforesaid", "notwithstanding", "indemnify", "indemnification", "estoppel", "force majeure", "lien", "covenant",
    "sine die", "prima facie", "ultra vires", "ex parte", "mutatis mutandis", "inter alia", "pursuant to", "liquidated damages", "subrogation", "novation", "arbitration", "jurisdiction", "injunction",
)


def cleaned(c: Column) -> Column:
    c = F.regexp_replace(c, "(?s)```.*?```", " ")
    return collapsed(F.regexp_replace(c, "[#*_>\\[\\]()-]", " "))


def syllables(word: Column) -> Column:
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(F.regexp_replace(w, "(?:es|ed|[^laeiouy]e)\\z", ""), F.lit("[aeiouy]{1,2}"))
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), groups))


def _all_syllables(words: Column) -> Column:
    """Syllables of all words: whole-text patterns over the words' letters, one for words of up to three letters, as ``syllables`` counts each."""
    letters = F.regexp_replace(F.lower(F.array_join(words, " ")), "[^a-z ]", "")
    long = F.trim(F.regexp_replace(F.regexp_replace(letters, "(?<![a-z])[a-z]{1,3}(?![a-z])", " "), " +", " "))
    bare = F.regexp_replace(long, "(?:es|ed|[^laeiouy ]e)(?![a-z])", "")
    parts = F.regexp_count(bare, F.lit("[aeiouy]{1,2}"))
    dumb = F.regexp_count(bare, F.lit("(?<![a-z])[b-df-hj-np-tv-xz]+(?![a-z])"))
    return F.coalesce(F.regexp_count(letters, F.lit("(?<![a-z])[a-z]{1,3}(?![a-z])")) + parts + dumb, F.lit(0)).cast("int")


def measures(c: Column) -> dict[str, Column]:
    """words, sentences, syllables and long words of a text."""
    clean = cleaned(c)
    words = F.filter(F.split(clean, " "), lambda w: w.rlike("[A-Za-z]"))
    sentences = F.filter(F.split(clean, f"[.!?]+(?:{WS}|\\z)"), lambda s: F.length(trimmed(s)) > 2)
    return {
        "words": F.greatest(F.lit(1), F.size(words)),
        "sentences": F.greatest(F.lit(1), F.size(sentences)),
        "syllables": _all_syllables(words),
        "long_words": F.size(F.filter(words, lambda w: F.length(w) > 12)),
    }


def flesch(words: Column, sentences: Column, syl: Column) -> Column:
    return F.floor((F.lit(206.835) - F.lit(1.015) * (words / sentences) - F.lit(84.6) * (syl / words)) * 10 + 0.5) / 10


def grade(words: Column, sentences: Column, syl: Column) -> Column:
    return F.floor((F.lit(0.39) * (words / sentences) + F.lit(11.8) * (syl / words) - F.lit(15.59)) * 10 + 0.5) / 10


def unexplained_jargon(c: Column) -> Column:
    """Terms whose first occurrence isn't explained within 160 characters."""
    low = F.lower(c)
    told = "means|meaning|that is|i\\.e\\.|in simple|in plain|— |- |\\(|\"|'"
    return F.array_compact(F.array(*(F.when(low.contains(t) & ~F.substring(low, F.locate(t, low), F.lit(160)).rlike(told), F.lit(t)) for t in JARGON)))
