"""Text columns: cleaning, terms, references, headings, labels. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the pattern language the rules were written for, spelt out (Java's own class differs).
WS = "[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: ASCII word boundary (Java's own is Unicode-aware).
B = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

def java(pattern: str) -> str:
    """A pattern written with ASCII word boundaries, digits and words, and Unicode white space, in Java's dialect."""
    return pattern.replace("\\b", B).replace("\\s", WS).replace("\\d", "[0-9]")


# Stop words, fillers and suffixes.
STOP_WORDS = (
    "a an the and or but if then than that this these those of in on at to for with by from as is are was were be been being it its "
    "i you he she they we me him her them my your our their what which who whom how when where why do does did done have has had "
    "not no nor so such can could should would may might must will shall about into over under again further once here there all "
    "any both each few more most other some only own same too very s t just don now"
).split()
FILLERS = "hereinafter hereto thereof therein whereas aforesaid hereby".split()
SUFFIXES = ("ations", "ation", "ements", "ement", "ingly", "edly", "ies", "ing", "ed", "es", "s")
HEADING = "(?i)" + "|".join(
    [
        f"^{WS}*(?:Section|Sec\\.|S\\.){WS}*\\d+[A-Z]{{0,2}}(?:[.—-]|{WS})",
        f"^{WS}*Article{WS}*\\d+[A-Z]{{0,2}}(?:[.—-]|{WS})",
        f"^{WS}*\\d+[A-Z]?\\.{WS}+[A-Z\"'(]",
        f"^{WS}*\\(\\d+\\){WS}",
        f"^{WS}*(?:CHAPTER|PART){WS}+[IVXLC\\d]+",
        f"^{WS}*\\d+(?:\\.\\d+){{1,3}}{WS}+(?!{WS}).",
    ]
)


def trimmed(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"\\A{WS}+|{WS}+\\z", "")


def collapsed(c: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def normalised(c: Column) -> Column:
    """LF line ends, no invisible breaks, single blanks, at most two line ends, hyphenated breaks joined, trimmed."""
    c = F.regexp_replace(c, "\\r\\n?", "\n")
    c = F.translate(c, "­​", "")
    c = F.regexp_replace(c, "[ \\t]+", " ")
    c = F.regexp_replace(c, "\\n{3,}", "\n\n")
    c = F.regexp_replace(c, "([A-Za-z0-9_])-\\n([A-Za-z0-9_])", "$1$2")
    return trimmed(c)


def stem(w: Column) -> Column:
    """The word without the first suffix that leaves four letters; words of up to four letters stay."""
    out = F.when(F.length(w) <= 4, w)
    for s in SUFFIXES:
        out = out.when(w.endswith(s) & (F.length(w) >= len(s) + 4), F.concat(F.left(w, F.length(w) - len(s)), F.lit("y" if s == "ies" else "")))
    return out.otherwise(w)


def glued(c: Column) -> Column:
    """Lower case, with numbers glued to section, article and clause."""
    c = F.lower(c)
    c = F.regexp_replace(c, f"{B}sec(?:tion)?s?\\.?{WS}*([0-9]+[a-z]*)", " section$1 ")
    c = F.regexp_replace(c, f"{B}art(?:icle)?s?\\.?{WS}*([0-9]+[a-z]*)", " article$1 ")
    return F.regexp_replace(c, f"{B}cl(?:ause)?\\.?{WS}*([0-9]+(?:\\.[0-9]+)*)", " clause$1 ")


def raw_terms(c: Column) -> Column:
    """The array of raw terms, stop words included."""
    return F.regexp_extract_all(glued(c), F.lit("[a-z0-9$₹]+"), F.lit(0))


def exploded_terms(df: DataFrame, text: Column, *keep: str, pos: bool = False) -> DataFrame:
    """One row a term (stemmed, stop words and short ones dropped); pos: with its place in the raw terms."""
    if pos:
        rows = df.select(*keep, F.posexplode(raw_terms(text)).alias("pos", "w"))
    else:
        rows = df.select(*keep, F.explode(raw_terms(text)).alias("w"))
    rows = rows.where((F.length("w") >= 2) & ~F.col("w").isin(*STOP_WORDS, *FILLERS))
    return rows.select(*keep, *(["pos"] if pos else []), stem(F.col("w")).alias("term"))


def extracted_ref(c: Column) -> Column:
    """The first section, else article, else clause the text names; null if none."""

    def first(pattern: str, label: str) -> Column:
        got = F.regexp_extract(c, pattern, 1)
        return F.when(got != "", F.concat(F.lit(label), got))

    return F.coalesce(
        first(f"(?i){B}(?:Section|Sec\\.?|S\\.){WS}*([0-9]+[A-Z]{{0,2}})", "S. "),
        first(f"(?i){B}Article{WS}*([0-9]+[A-Z]{{0,2}})", "Art. "),
        first(f"(?i){B}Clause{WS}*([0-9]+(?:\\.[0-9]+)*)", "Cl. "),
    )


def is_heading(line: Column) -> Column:
    """Whether a line opens a section, article, clause, chapter or numbered paragraph."""
    return line.rlike(HEADING)


def marginal_note(block: Column) -> Column:
    """The note before the first full stop or dash of a block; null if it is too short or long."""
    body = F.regexp_replace(F.regexp_replace(block, f"(?i)\\A{WS}*Section{WS}+[0-9A-Z]+\\.{WS}*", ""), f"\\A{WS}+", "")
    head = F.regexp_extract(body, "\\A([^.—]*)[.—]", 1)
    return F.when((F.length(head) >= 4) & (F.length(head) <= 140) & (F.length(trimmed(head)) > 3), trimmed(head))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "\\A-|-\\z", "")


def leading_int(c: Column) -> Column:
    return F.regexp_extract(c, "\\A([0-9]+)", 1).try_cast("int")


def looks_like_section(c: Column) -> Column:
    return c.rlike(f"\\A(?:[0-9\\[\\]*]|{WS})*[A-Z][^.—]{{3,120}}?{WS}*[.—]")


def user_name(c: Column) -> Column:
    """Trimmed lower case letters, digits, _ and -, 32 characters; null under two."""
    s = F.substring(F.regexp_replace(F.lower(trimmed(c)), "[^a-z0-9_-]", ""), 1, 32)
    return F.when(F.length(s) >= 2, s)


def device_id(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, "[^A-Za-z0-9_-]", ""), 1, 40)


def chat_title(c: Column) -> Column:
    s = collapsed(c)
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, "New chat").when(F.length(s) > 52, F.concat(F.left(s, F.lit(52)), F.lit("..."))).otherwise(s)


def file_title(c: Column) -> Column:
    return F.regexp_replace(c, "\\.[^.]+\\z", "")


def act_display(c: Column) -> Column:
    return F.regexp_replace(c, f",?{WS}*[0-9]{{4}}\\z", "")


def capped(c: Column, limit: int = 400_000) -> Column:
    return F.left(c, F.lit(limit))


def plain_words(c: Column) -> Column:
    """Stock phrases of deeds in plain words (first 4,000 characters)."""
    c = F.left(c, F.lit(4000))
    # Phrase and replacement.
    for old, new in (("hereinafter", "from now on"), ("heretofore", "before now"), ("whereas", "because"), ("notwithstanding", "despite"), ("shall", "must"), ("thereof", "of that"), ("party of the first part", "the first party"), ("party of the second part", "the second party")):
        c = F.regexp_replace(c, f"(?i){B}{old}{B}", new)
    return trimmed(F.regexp_replace(F.regexp_replace(c, "\\n{2,}", "\n\n"), "[ \\t]+", " "))


def citation_label(n: Column, source: Column, title: Column, ref: Column, page: Column) -> Column:
    where = F.when(source == "user", "YOUR DOCUMENT").otherwise("LAW")
    return F.concat(F.lit("["), n.cast("string"), F.lit("] ("), where, F.lit(") "), F.concat_ws(" - ", title, ref, F.concat(F.lit("p."), page.cast("string"))))


def relative_time(then: Column, now: Column) -> Column:
    s = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, "now").when(s < 3600, part(60, "m")).when(s < 86400, part(3600, "h")).when(s < 604800, part(86400, "d")).otherwise(F.date_format(then, "yyyy-MM-dd"))


def salvaged_json(c: Column) -> Column:
    """A JSON text out of an answer: without code fences, else from the first to the last brace; null if neither parses."""
    bare = trimmed(F.regexp_replace(c, "(?i)```(?:json)?", ""))
    inner = F.regexp_extract(bare, "(?s)\\{.*\\}", 0)
    valid = lambda x: F.when(F.expr("true") & (F.schema_of_variant(F.try_parse_json(x)).isNotNull()), x)
    return F.coalesce(valid(bare), valid(F.nullif(inner, F.lit(""))))
