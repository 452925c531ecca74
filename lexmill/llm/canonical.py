"""Problem 3: one form for texts that look the same.

Method: for every token the script sets of its letters (each letter's own script and the
scripts that have a look-alike of it) are intersected to the resolved script set. A token whose
letters have different scripts (mixed-script confusable) or whose letters all have a Latin
look-alike (whole-script confusable) is spelt in the script of the intersection; Latin wins
where several remain. Everything else that can't be seen is normalised: width, ligatures,
composition, kinds of blank, invisible characters.

Kept apart, as they can be seen: case, accents, digits of different scripts, marks, the number
of blanks, tabs and line ends.

Null stays null; an empty or blank text is a text but never a case of a pair query. Very long texts
are read once. Copies are resolved at the level of distinct texts before rows are paired.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import written

# Invisible characters, blanks, ligatures and look-alike letters.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿"
BLANKS = "               　"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
CYRILLIC = dict(zip("аеорсухѕіјһԁԛԝАВЕЅІЈКМНОРСТХУԌԚԜ", "aeopcyxsijhdqwABESIJKMHOPCTXYGQW"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ", "ABEZHIKMNOPTYXoj"))
ARMENIAN = dict(zip("օսոհզցՕՍՏԼ", "ounhqgOUSL"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᎥ", "ABCDEHJKLMPRSTVWZi"))
LOOK = {"C": CYRILLIC, "G": GREEK, "A": ARMENIAN, "K": CHEROKEE}


def _styled() -> dict[int, str]:
    """By rule: letters that are font styles of others (mathematical, letterlike) and letter numerals written as one character."""
    out = {}
    for c in [*range(0x2100, 0x2190), *range(0x1D400, 0x1D800)]:
        kind, _, rest = unicodedata.decomposition(chr(c)).partition(" ")
        to = unicodedata.normalize("NFKC", chr(c))
        if (kind == "<font>" or kind == "<compat>" and unicodedata.category(chr(c)) == "Nl") and rest and to.isalpha():
            out[c] = to
    return out


_CHARS = _styled() | {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in BLANKS} | {ord(k): v for k, v in LIGATURES.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_STYLED = re.compile("[\u2100-\u218f\U0001d400-\U0001d7ff]")
_NEEDS_CHARS = re.compile("[" + "".join(re.escape(chr(c)) for c in _CHARS if c not in _styled()) + "]")
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ԰-֏Ꭰ-\u13ff]")
_TOKEN = re.compile("[A-Za-zÀ-ɏ̀-ͯͰ-ϿЀ-ԯ԰-֏Ꭰ-\u13ff]+")
#: Back from Latin, for tokens that can only be Cyrillic or Greek (first listed wins).
_BACK = {s: {v: k for k, v in reversed(list(m.items()))} for s, m in LOOK.items()}

def _script(c: str) -> str:
    o = ord(c)
    if o < 0x300 or o > 0x13FF:
        return "L"
    return "" if o <= 0x36F else "G" if o <= 0x3FF else "C" if o <= 0x52F else "A" if 0x530 <= o <= 0x58F else "K" if o >= 0x13A0 else "L"


def _spell(m: re.Match) -> str:
    """The token in the script that its resolved script set selects."""
    token = m.group()
    if not _FOREIGN.search(token):
        return token
    chars = unicodedata.normalize("NFD", token)
    own = {_script(c) for c in chars} - {""}
    resolved = {"L", *LOOK}
    for c in chars:
        s = _script(c)
        if s == "L":
            resolved &= {"L"} | {o for o in LOOK if c in _BACK[o]}
        elif s:
            sets = {s} | ({"L"} if c in LOOK[s] else set())
            sets |= {o for o in LOOK if o != s and LOOK[s].get(c) in _BACK[o]}
            resolved &= sets
    if not resolved or (len(own) == 1 and "L" not in resolved):
        return token
    if "L" in resolved:
        chars = "".join(LOOK.get(_script(c), {}).get(c, c) for c in chars)
    else:
        to = sorted(resolved)[0]
        chars = "".join(c if _script(c) in (to, "") else _BACK[to].get(LOOK.get(_script(c), {}).get(c, c), c) for c in chars)
    return unicodedata.normalize("NFC", chars)


def one_form(text: str | None) -> str | None:
    """The one form of a text."""
    if text is None or text.isascii():
        return text
    if _NEEDS_CHARS.search(text) or _STYLED.search(text):
        text = text.translate(_CHARS)
    text = unicodedata.normalize("NFC", text)
    if _FOREIGN.search(text):
        text = _TOKEN.sub(_spell, text)
    return text


@F.pandas_udf(T.StringType())
def _one_form(texts: pd.Series) -> pd.Series:
    return pd.Series([one_form(t) for t in texts], index=texts.index, dtype=object)


def one_form_column(text: Column) -> Column:
    """The one form as a column. Only texts with a character beyond ASCII travel to Python; the others are in the form already."""
    wide = F.octet_length(text) != F.length(text)
    return F.when(wide, _one_form(F.when(wide, text))).otherwise(text)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def form_keys(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(key, form, stored): 128-bit digests of the one form and of the stored text of every text that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            forms = [one_form(t) for t in texts]
            stored = [_digest(t) for t in texts]
            same = [s if f is t else None if not f.strip() else _digest(f) for t, f, s in zip(texts, forms, stored)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.array(stored, pa.binary())], ["key", "form", "stored"])
            yield out.filter(out.column(1).is_valid())

    rows = df.select(F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text")).where(F.col("key").isNotNull() & F.col("text").rlike("\\S"))
    return rows.mapInArrow(run, f"key {df.schema[key_col].dataType.simpleString()}, form binary, stored binary")


def look_alike_classes(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(key, class, spellings) of every text that isn't blank: the smallest key of its one form, and how many stored texts have that form.

    Groups are counted before they are joined back, so a form that a third of the rows share isn't gathered anywhere.
    """
    rows = written(form_keys(df, key_col, text_col), "forms")
    stored = rows.groupBy("form", "stored").agg(F.min("key").alias("key"))
    classes = stored.groupBy("form").agg(F.min("key").alias("class"), F.count("*").alias("spellings"))
    return rows.select("form", "key").join(classes, "form").select("key", "class", "spellings")


def look_alike_pairs(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(key_a, key_b), key_a < key_b: rows whose texts have one form but are stored differently.

    Distinct stored texts of one form are paired first and then joined to their rows, so the work follows
    the pairs put out, however large a group of equal texts is.
    """
    rows = written(form_keys(df, key_col, text_col), "forms")
    varied = rows.groupBy("form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("form")
    rows = written(rows.join(varied, "form", "left_semi"), "varied")
    texts = rows.select("form", "stored").distinct()
    other = texts.select("form", F.col("stored").alias("stored_b"))
    pairs = texts.join(other, "form").where("stored < stored_b").select("stored", "stored_b")
    out = pairs.join(rows.select("stored", F.col("key").alias("a")), "stored")
    out = out.join(rows.select(F.col("stored").alias("stored_b"), F.col("key").alias("b")), "stored_b")
    return out.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).where("key_a < key_b").distinct()
