"""Problem 10: texts cut off by field limits or in transfer.

Method: every text's length is computed under alternative encodings (code points, UTF-8 bytes,
UTF-16 units, HTML escapes, JSON escapes, CRLF and LF line ends) and the lengths are grouped by source
and encoding. A limit shows as a pile of texts just at one length that few texts of the source
pass; a source may have several. Then the endings are inspected, and the limits say what an ending means: texts
at a limit are mostly cut, texts away from all limits mostly whole, so two mixtures of the same two components
(endings of cut and of whole texts) are fitted by EM to the counts of endings at and away from limits. A text is cut if that is
the likelier of the two for its ending where it stands: an abbreviation, a list number, a sign or a title line at the end may be cut at a limit and whole
away from it. A sentence end and a whole last line are never cut, text without letters isn't either.

Null, empty and blank texts aren't cut. Signature, date, place, copy, annexure, reference and
closing-mark lines are whole endings. A null source is a source of its own. Texts are judged in built-in expressions;
the driver sees one row for each kind of ending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.canonical import one_form_column
from lexmill.llm.common import written

#: What may follow a text unseen, what ends a sentence, what closes a quotation.
_UNSEEN = "[\\s\\u00a0\\u2000-\\u200f\\u202f\\u205f\\u2060\\u3000\\ufeff\\u00ad\\u2028\\u2029]"
_END = ".?!।॥。．？！"
_CLOSE = "\"'”’»)\\]）］"
_MARK = "(\\.{2,}|…|\\ufffd|\\[(?i:more|cont[a-z.']*|truncated|cut|snip|\\.\\.\\.|…)\\]|\\((?i:more|cont[a-z.']*|truncated)\\)|(?i:read more|>>+|-->))"
_WHOLE_LINE = (
    "(?i)^\\W{0,3}(copy to|copies to|cc|c\\.c\\.)\\b.{0,90}$"
    "|^\\W{0,3}(date[ds]?|place|ref|reference|our ref|file no|enclosures?|encl)\\.?( no\\.?)?\\s*[:.].{0,90}$"
    "|^\\W{0,3}(annexure|appendix|schedule)\\s*[-a-z0-9]{0,5}\\s*[:.].{0,90}$"
    "|^\\W{0,3}(sd/-|signed by|signature|by order of|yours (faithfully|sincerely|truly)).{0,60}$"
    "|^\\W*(\\*\\W*\\*\\W*\\*|-\\W*-\\W*-|=+|#+|_+|~+|\\*{2,}|—+|-{2,})\\W*$"
    "|^\\[\\s*(?i:end)\\b.{0,60}\\]$|^\\W*(?i:the end|end|finis)\\W*$"
)
_TITLE = "^(?=.{3,70}$)\\P{Ll}*(?:\\p{Lu}[\\p{L}\\p{M}'’.-]*|\\p{Nd}+|of|the|and|for|in|to|a|an|on|by|or|at|with|&|[-–—:/()]|\\s)+$"
#: What is known of endings before any text is seen, in texts: kind: (of cut texts, of whole texts). Sentence ends and whole lines are never cut.
ENDINGS = {"inside": (30.0, 0.1), "mark": (10.0, 0.1), "title": (6.0, 0.05), "loose": (3.0, 0.05), "sign": (0.5, 1.0), "sentence": (0.0, 30.0), "whole": (0.0, 10.0)}
#: A pile is a limit: at least so many texts, so many times as dense as the lengths below, with at most this share of texts beyond.
#: A pile that many texts pass is a limit (of one field among several) if it is SPIKE times as dense as the lengths on both sides.
MIN_PILE, DENSITY, BEYOND, SPIKE = 5, 8.0, 0.05, 10.0
MIN_LIMIT, TAIL, REACH = 40, 4, 100


def _count(text: Column, part: str) -> Column:
    """How often the text has the (one-character or CRLF) part."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def lengths(text: Column) -> dict[str, Column]:
    """The text's length under each encoding."""
    chars, octets = F.length(text), F.octet_length(text)
    astral = F.when(octets > chars, F.regexp_count(text, F.lit("[\\x{10000}-\\x{10ffff}]"))).otherwise(0)
    quote, lf, crlf = _count(text, '"'), _count(text, "\n"), _count(text, "\r\n")
    return {
        "chars": chars,
        "bytes": octets,
        "utf16": chars + astral,
        "html": chars + 4 * _count(text, "&") + 3 * (_count(text, "<") + _count(text, ">")) + 5 * quote + 4 * _count(text, "'"),
        "json": chars + quote + lf + _count(text, "\\") + _count(text, "\r") + _count(text, "\t"),
        "crlf": chars + lf - crlf,
        "lf": chars - crlf,
    }


def _inspected(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row a text: its lengths and how it ends."""
    text, body, last = F.col("__text"), F.col("__body"), F.col("__last")
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).cast("string").alias("__text"))
    # an ending needs no more than the last lines; look-alike spellings of them are read in the one form
    rows = rows.withColumn("__tail", one_form_column(F.right(text, F.lit(300))))
    rows = rows.withColumn("__body", F.regexp_replace(F.rtrim("__tail"), f"{_UNSEEN}+\\z", ""))
    rows = rows.withColumn("__lines", F.split(body, "[\\n\\r]+"))
    rows = rows.withColumn("__last", F.trim(F.element_at("__lines", -1)))
    rows = rows.withColumn("__end", F.right("__last", F.lit(24))).withColumn("__short", F.when(F.length("__last") <= 110, F.col("__last")).otherwise(""))
    end, short = F.col("__end"), F.col("__short")
    signed = F.trim(F.coalesce(F.get("__lines", F.size("__lines") - 2), F.lit(""))).rlike("(?i)^(sd/-|signed|yours .{0,30}|by order.{0,30})\\W*$")
    loose = F.right(body, F.lit(24)).rlike("(^|[\\n\\r]|[.?!।] )\\(?[0-9]{1,3}[.)]\\z") | end.rlike("(?i)(^|[^a-z])(rs|no|nos|dr|smt|shri|mr|mrs|ms|adv|cl|art|sec|vs|viz)\\.\\z")
    return rows.select(
        "id",
        "source",
        F.when(text.rlike("\\S"), F.struct(*(c.cast("int").alias(k) for k, c in lengths(text).items()))).alias("len"),
        F.when(text.isNull() | ~last.rlike("[\\p{L}\\p{M}\\p{N}]") & ~body.rlike("[\\p{L}\\p{M}]"), "none")
        .when(end.rlike(f"{_MARK}\\z"), "mark")
        .when(short.rlike(_WHOLE_LINE) | signed, "whole")
        .when(loose, "loose")
        .when(end.rlike(f"[{_END}][{_CLOSE}]*\\z"), "sentence")
        .when(end.rlike("[\\p{So}\\p{Sk}>|#*]\\z"), "sign")
        .when((F.size("__lines") > 1) & short.rlike(_TITLE), "title")
        .otherwise("inside")
        .alias("ending"),
    )


def hidden_limits(inspected: DataFrame) -> DataFrame:
    """(source, encoding, limit, at_limit, passed, texts) of each exposed limit; passed: many texts of the source are longer. One row for each source, encoding and length travels."""
    encodings = [f.name for f in inspected.schema["len"].dataType.fields]
    pairs = F.explode(F.array(*(F.struct(F.lit(e).alias("encoding"), F.col(f"len.{e}").alias("n")) for e in encodings)))
    counts = inspected.where("len is not null").groupBy("source", "len").count().select("source", pairs.alias("p"), "count")
    counts = counts.groupBy("source", "p.encoding", "p.n").agg(F.sum("count").alias("here"))
    by = Window.partitionBy("source", "encoding").orderBy("n")
    every = Window.partitionBy("source", "encoding")
    return (
        counts.withColumn("pile", F.sum("here").over(by.rangeBetween(-TAIL + 1, 0)))
        .withColumn("near", F.sum("here").over(by.rangeBetween(-REACH - TAIL, -TAIL)))
        .withColumn("past", F.sum("here").over(by.rangeBetween(1, REACH)))
        .withColumn("beyond", F.sum("here").over(every) - F.sum("here").over(by))
        .withColumn("texts", F.sum("here").over(every))
        .where((F.col("n") >= MIN_LIMIT) & (F.col("pile") >= MIN_PILE))
        .where(F.col("pile") >= DENSITY * TAIL / REACH * F.coalesce("near", F.lit(0)))
        .withColumn("passed", ~(F.col("beyond") <= BEYOND * F.col("pile") + 0.02 * F.col("texts")))
        .where(~F.col("passed") | (F.col("pile") >= SPIKE * (1 + TAIL / REACH * F.greatest(F.coalesce("near", F.lit(0)), F.coalesce("past", F.lit(0))))))
        .select("source", "encoding", F.col("n").alias("limit"), F.col("pile").alias("at_limit"), "passed", "texts")
    )


def ending_model(counts: dict[tuple[str, bool], int], rounds: int = 60) -> dict[tuple[str, bool], float]:
    """Probability that a text is cut, by its ending and whether it stands at a limit: EM over the counts of (ending, at a limit)."""
    places = {True: (9.0, 1.0), False: (0.5, 9.5)}  # known of texts at and away from limits: cut, whole
    seen = {(k, at): counts.get((k, at), 0) for k in ENDINGS for at in places}
    p = dict.fromkeys(seen, 0.0)
    first = True
    for _ in range(rounds):
        cut = {k: a + sum(seen[k, at] * p[k, at] for at in places if not first) for k, (a, _) in ENDINGS.items()}
        whole = {k: b + sum(seen[k, at] * (1 - p[k, at]) for at in places if not first) for k, (_, b) in ENDINGS.items()}
        for at, (a, b) in places.items():
            share = a / (a + b) if first else (a + sum(seen[k, at] * p[k, at] for k in ENDINGS)) / (a + b + sum(seen[k, at] for k in ENDINGS))
            for k in ENDINGS:
                x, y = share * cut[k] / sum(cut.values()), (1 - share) * whole[k] / sum(whole.values())
                p[k, at] = x / (x + y)
        first = False  # at first by what is known beforehand
    return p


def truncated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a text: id, source, ending, limit_by (the encoding of a limit it reaches, else null) and cut."""
    seen = written(_inspected(df, id_col, text_col, source_col), "endings")  # texts are read once: a few numbers a text go on
    limits = hidden_limits(seen).groupBy("source").agg(F.collect_list(F.struct("encoding", "limit", "at_limit", "passed")).alias("limits"))  # one row a source, of its few limits
    seen = seen.alias("s").join(limits.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")), "left").select("s.*", "l.limits")
    size = lambda e: F.coalesce(*(F.when(e == f.name, F.col(f"len.{f.name}")) for f in seen.schema["len"].dataType.fields))
    reached = F.filter("limits", lambda x: size(x.encoding).between(x.limit - TAIL, x.limit))
    first = F.element_at(F.array_sort(F.transform(reached, lambda x: F.struct(x.passed.alias("p"), (-x.at_limit).alias("n"), x.encoding.alias("e")))), 1)
    seen = written(seen.withColumn("limit_by", F.when(F.size(reached) > 0, first["e"])).select("id", "source", "ending", "limit_by"), "limits")
    at = F.col("limit_by").isNotNull()
    counts = {(r.ending, r.at): r.n for r in seen.groupBy("ending", at.alias("at")).agg(F.count("*").alias("n")).collect()}  # one row a kind of ending
    p = ending_model(counts)
    cut = F.concat_ws("/", "ending", at.cast("string")).isin(*(f"{k}/{str(x).lower()}" for (k, x), v in p.items() if v > 0.5))
    return seen.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "ending", "limit_by", cut.alias("cut"))


def truncation_rates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each source truncates: source, texts, cut, rate, at_limit (cut texts that end at an exposed limit)."""
    return (
        truncated(df, id_col, text_col, source_col)
        .groupBy(source_col)
        .agg(
            F.count("*").alias("texts"),
            F.count_if("cut").alias("cut"),
            F.round(F.count_if("cut") / F.count("*"), 6).alias("rate"),
            F.count_if(F.col("cut") & F.col("limit_by").isNotNull()).alias("at_limit"),
        )
    )
