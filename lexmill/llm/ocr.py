"""Problem 1: repair text extracted from scanned pages.

Method: words are grouped by their confusable-glyph skeleton; in each group a rarer form may be a misreading of a far more
frequent form if the known glyph confusions lead from one to the other. Where a form is too frequent to be a misreading only (over 1 / ``SURE`` of the other), or several
frequent forms are possible, every occurrence is judged by its context: it is what its neighbours support most often, the form as it was read included. Running headers and footers are lines at page edges
that recur, digits masked, on pages of the document or at page edges of other documents. Words broken over a line (or page) end, by any
of ``HYPHENS``, are rejoined where the whole corpus knows the joined form rather than the hyphenated one. Lines are then reflowed
to paragraphs with SQL windows over page order.

A first word of a page is no word of its own where the page before ends in a broken one. Null and empty pages have no lines and no paragraphs. Pages extracted twice are judged each; repairs of a document use the latest
extraction of a page. Counts cover all pages. Only a list of the ``COMMON`` most frequent words is broadcast (a
bounded filter that spares look-ups; words outside it are joined, none is dropped).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import written

EDGE, COMMON, RATIO, SURE, LEAST, SHORT = 3, 20_000, 8, 50, 5, 90
#: Of all words of the corpus: first halves of hyphenated words from this share on (and from LEAST on) are known ones.
KNOWN_FIRST = 2e-6

# Glyph confusions of scanned Latin print, read form for true form.
CONFUSIONS = [("!", "i"), ("l", "i"), ("1", "i"), ("1", "l"), ("I", "l"), ("i", "l"), ("!", "l"), ("|", "l"), ("0", "o"), ("5", "s"), ("6", "b"), ("9", "g"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"),
              ("li", "h"), ("h", "li"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("vv", "w"), ("w", "vv"), ("h", "ti"), ("ti", "h")]
#: A glyph pair may itself be misread: each of its letters in turn by the confusions of single glyphs.
CONFUSIONS += sorted({(a[:k] + x + a[k + 1 :], b) for a, b in CONFUSIONS if len(a) == 2 for x, y in CONFUSIONS if len(x) == len(y) == 1 for k in (0, 1) if a[k] == y} - set(CONFUSIONS))
#: Strokes that stay the same under all confusions.
_STROKES = str.maketrans({**dict.fromkeys("fti1l!|", "i"), **dict.fromkeys("uh", "ii"), "n": "ri", "m": "rri", "d": "ei", "c": "e", "w": "vv", "0": "o", "6": "b", "9": "g", "5": "s"})
_STRIP = ".,;:()[]{}\"'“”‘’?…—–"
_LETTER = re.compile(r"[^\W\d_]")
_ODD = re.compile(r"[@/\\]|\d{2,}|^\d+(?:st|nd|rd|th)$|^\d?[^\W\d_]$|^[^\W\d_]\d$", re.I)
#: Signs at the end of a line that break a word: hyphen-minus, hyphen, non-breaking hyphen, soft hyphen, not sign.
HYPHENS = "-\u2010\u2011\u00ad\u00ac"
#: From the sign of a broken word to the end of its rest on the next line.
_BROKEN = re.compile(f"[{HYPHENS}](?<=[^\\W\\d_].)[^\\S\\n]*\\n\\s*\\S+")
_SMALL = frozenset("of the and for in to a an on by or at with".split())
_NUMBER = re.compile(r"(?<![^\W_])\d[\d,./-]*(?![^\W_])")
_PAGE = re.compile(r"^\W*(?:(?:page|paqe|pg|p)\W*)?(\d{1,4}|[ivxl]{1,7}|[l|!])(?:\W*(?:of|/)\W*\d{1,4})?(?:\W*page)?\W*$", re.I)
_END = re.compile(r"[.,;:?!]$")


def skeleton(word: str) -> str:
    """The strokes of a word, alike for all forms that scanning confuses."""
    return word.lower().translate(_STROKES)


def bare(token: str) -> str:
    """A token without the marks around it, in lower case."""
    return token.strip(_STRIP).lower()


@lru_cache(maxsize=100_000)
def misread_of(read: str, true: str) -> bool:
    """Whether glyph confusions alone lead from the true form to the read form (which differs)."""
    if read == true:
        return False
    reach = {(0, 0)}
    while reach:
        new = set()
        for i, j in reach:
            if i == len(read) and j == len(true):
                return True
            if i < len(read) and j < len(true) and read[i] == true[j]:
                new.add((i + 1, j + 1))
            for a, b in CONFUSIONS:
                if read.startswith(a.lower(), i) and true.startswith(b, j):
                    new.add((i + len(a), j + len(b)))
        reach = new
    return False


def line_key(line: str) -> str:
    """A line with numbers masked and glyphs as strokes."""
    return " ".join(skeleton(_NUMBER.sub("#", line)).split())


#: Digits as they are misread.
_DIGITS = str.maketrans({"l": "1", "O": "0"})


def titled(line: str) -> bool:
    """Whether a line is set like a title: its words begin with capitals, small ones aside."""
    words = [w for w in line.split() if _LETTER.search(w) and w.lower() not in _SMALL]
    return len(words) >= 2 and sum(not w[:1].islower() for w in words) >= 0.75 * len(words)


def _roman(s: str) -> int:
    value = {"i": 1, "v": 5, "x": 10, "l": 50}
    ds = [value[c] for c in s.lower()]
    return sum(-d if k + 1 < len(ds) and d < ds[k + 1] else d for k, d in enumerate(ds))


def page_number(line: str) -> tuple[int, bool] | None:
    """(value, explicit) if a line can be nothing but a page number; explicit: it says so."""
    s = " ".join(line.split())
    if len(s) > 24 or s.endswith("."):
        return None
    s = re.sub(r"p\s?a\s?g\s?[ec]", "page", s, flags=re.I)
    s = re.sub(r"(?<![A-Za-z\d])[\dlO]+(?![A-Za-z\d])", lambda m: m.group().translate(_DIGITS), s)
    m = _PAGE.match(s)
    if not m:
        return None
    v = m.group(1)
    value = int(v) if v.isdigit() else 1 if v in "l|!I" and v != "I" else _roman(v) if re.fullmatch(r"[ivxl]+", v, re.I) else 1
    explicit = bool(re.search(r"page|pg|\bof\b|^-.*-$|^~.*~$|\d/\d", s, re.I))
    return value, explicit


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every batch of pages: word counts ('w'), keys of lines inside pages ('m'), and the lines at page edges ('e')."""
    names = ["kind", "word", "n", "page_no", "doc_id", "page", "line_no", "value", "explicit", "ended", "titled"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_()]
    for b in batches:
        words: Counter[str] = Counter()
        inside: Counter[str] = Counter()
        rows: list[tuple] = []
        for page_no, doc, page, text in zip(*(c.to_pylist() for c in b.columns)):
            lines = text.split("\n")
            words.update(_BROKEN.sub("- ", text).split())  # the half keeps a hyphen, by which it is left out below
            full = [i for i, x in enumerate(lines) if x.strip()]
            edge = set(full[:EDGE] + full[-EDGE:])
            for i in full:
                line = lines[i].strip()
                if i in edge:
                    number = page_number(line)
                    rows.append(("e", line_key(line), 1, page_no, doc, page, i + 1, number and number[0], number and number[1], bool(_END.search(line)), titled(line)))
                elif len(line) < SHORT and not _END.search(line) and not lines[i - 1].strip():
                    inside[line_key(line)] += 1
        clean: Counter[str] = Counter()
        for t, n in words.items():
            w = bare(t)
            if w and _LETTER.search(w) and w[-1] not in HYPHENS:
                clean[w] += n
        rows += [("w", w, n, *[None] * 8) for w, n in clean.items()]
        rows += [("m", k, n, *[None] * 8) for k, n in inside.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


_SCAN = "kind string, word string, n long, page_no long, doc_id string, page int, line_no int, value int, explicit boolean, ended boolean, titled boolean"


def _pages(df: DataFrame) -> DataFrame:
    return df.where("page_no is not null and text is not null and doc_id is not null").select(F.col("page_no").cast("long"), "doc_id", F.col("page").cast("int"), "text")


def edge_lines(scanned: DataFrame) -> DataFrame:
    """(page_no, line_no, kind): the header, footer and page number lines."""
    # keys travel as 64-bit hashes: an edge line's row is small however long the line
    lettered = F.length(F.regexp_replace("word", "[^a-zA-Z]", "")) >= 4
    e = scanned.where("kind = 'e'").select("page_no", F.xxhash64("doc_id").alias("doc"), "page", "line_no", F.xxhash64("word").alias("key"), lettered.alias("lettered"), "value", "explicit", "ended", "titled")
    here = e.groupBy("doc", "key").agg(F.count_distinct("page").alias("pages"))
    there = e.groupBy("key").agg(F.count_distinct("doc").alias("docs"), F.count("*").alias("edges"))
    running = here.where("pages >= 2").groupBy("key").agg(F.count("*").alias("running"))
    inside = scanned.where("kind = 'm'").groupBy(F.xxhash64("word").alias("key")).agg(F.sum("n").alias("mid"))
    keys = there.join(inside, "key", "left").join(running, "key", "left").na.fill(0, ["mid", "running"])
    shift = e.where("value is not null").groupBy("doc", (F.col("value") - F.col("page")).alias("shift")).agg(F.count_distinct("page").alias("alike"))
    e = e.join(here, ["doc", "key"]).join(keys, "key").withColumn("shift", F.col("value") - F.col("page")).join(shift, ["doc", "shift"], "left")
    number = F.col("value").isNotNull() & (F.col("explicit") | (F.col("shift") == 0) | (F.col("alike") >= 2))
    apart = F.col("value").isNull() & (F.col("mid") * 20 <= F.col("edges")) & F.col("lettered")
    often = (F.col("pages") >= 2) | (F.col("running") >= 2) | (F.col("titled") & (F.col("docs") >= 2))
    header = apart & F.when(F.col("ended"), F.col("pages") >= 3).otherwise(often)
    return e.select("page_no", "line_no", F.when(number, "pageno").when(header, "header").alias("kind")).where("kind is not null")


def _with_bones(words: DataFrame) -> DataFrame:
    """(word, n, bones): counted words with their skeletons."""

    def bones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([skeleton(w) for w in b.column(0).to_pylist()], pa.string())], ["word", "n", "bones"])

    return words.select("word", "n").mapInArrow(bones, "word string, n long, bones string")


def word_forms(scanned: DataFrame) -> DataFrame:
    """(word, n, bones): every word of the corpus with its count and skeleton."""
    return _with_bones(scanned.where("kind = 'w'").groupBy("word").agg(F.sum("n").alias("n")))


def corrections(forms: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(word, form, n, own): for every word of the corpus (or of other counted words) that may be misread the frequent forms it may stand for, with their and its own count."""
    most = F.max("n").over(Window.partitionBy("bones"))
    grouped = forms.where(F.length("word").between(2, 40)).withColumn("most", most)
    frequent = grouped.where((F.col("n") >= LEAST) & (F.col("n") * 4 >= F.col("most"))).select("bones", F.col("word").alias("form"), F.col("n").alias("form_n"))
    if others is not None:
        grouped = others.where(F.length("word").between(2, 40)).join(forms.where(F.length("word").between(2, 40)).groupBy("bones").agg(F.max("n").alias("most")), "bones")
    rare = grouped.where((F.col("n") * RATIO <= F.col("most")) & (F.col("most") >= LEAST)).select("bones", "word", "n")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [bool(misread_of(w, f)) and not _ODD.search(w) for w, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    both = rare.join(frequent, "bones").where((F.col("form_n") >= RATIO * F.col("n")) & (F.col("word") != F.col("form")))
    return both.select("word", "form", F.col("form_n").alias("n"), F.col("n").alias("own")).mapInArrow(check, "word string, form string, n long, own long")


def _unmarked(word: Column | str) -> Column:
    """The word without marks, in lower case."""
    return F.lower(F.regexp_replace(word, "[.,;:()\\[\\]{}\"'“”‘’?…—–]+", ""))


class _Plan:
    """The tables of one corpus."""

    def __init__(self, df: DataFrame) -> None:
        self.pages = _pages(df)
        self.scanned = written(self.pages.mapInArrow(_scan, _SCAN), "page-scan")
        self.edges = written(edge_lines(self.scanned), "page-edges")
        self.forms = written(word_forms(self.scanned), "page-words")
        self.corrections = written(corrections(self.forms), "page-forms")
        common = self.forms.join(self.corrections.select("word").distinct(), "word", "left_anti").orderBy(F.desc("n"), "word").limit(COMMON)
        self.common = df.sparkSession.sparkContext.broadcast(frozenset(r.word for r in common.select("word").collect()))
        # words judged by context, and what they may stand for: the vocabulary's, whatever the number of pages
        many = self.corrections.groupBy("word").agg(F.count("*").alias("forms"), F.max("n").alias("most"), F.max("own").alias("own"))
        doubtful = many.where((F.col("forms") > 1) | (F.col("own") >= LEAST) & (F.col("own") * SURE > F.col("most"))).select("word")
        self.doubtful = written(self.corrections.join(doubtful, "word"), "page-doubts")
        heads = self.doubtful.select(F.explode(F.array("word", "form")).alias("word")).distinct()
        self.heads = df.sparkSession.sparkContext.broadcast(frozenset(r.word for r in heads.collect()))
        self.words = self.forms.agg(F.sum("n")).first()[0] or 0
        # what a page is asked for is looked up in one pass over the texts; only these rows meet the edge lines, never the texts
        seen = self.pages.mapInArrow(self._look(), self._LOOK)
        away = self.edges.groupBy("page_no").agg(F.collect_set("line_no").alias("away"))  # at most 2 x EDGE lines a page
        rows = seen.join(away, "page_no", "left").withColumn("away", F.coalesce("away", F.array().cast("array<int>")))
        body = F.filter("ahead", lambda x: ~F.array_contains(F.col("away"), x.line))
        rows = rows.where("kind in ('n', 'x') or not array_contains(away, line_no)").withColumn("next", F.get(body, 0)["word"]).withColumn("next_line", F.get(body, 0)["line"])
        self.lines = written(rows.drop("away", "ahead"), "page-lines")

    _LOOK = "kind string, page_no long, doc_id string, page int, line_no int, word string, before string, after string, half string, ahead array<struct<line:int,word:string>>"

    def _look(self):
        """Rare and doubtful words of lines ('c'; half: 't' at the top of a page), broken line ends ('h'), the first words of a page ('n') and counted neighbours of doubtful words ('x'; in line_no). ahead: the lines that may come next."""
        common, doubtful = self.common, self.heads
        asked = df_words(self.doubtful)
        names = ["kind", "page_no", "doc_id", "page", "line_no", "word", "before", "after", "half", "ahead"]
        ahead_type = pa.list_(pa.struct([("line", pa.int32()), ("word", pa.string())]))
        types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4, ahead_type]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, heads = common.value, doubtful.value
            judged: dict[str, str] = {}  # tokens met before: their bare form, empty if they need no look
            for b in batches:
                rows: list[tuple] = []
                beside: Counter[tuple] = Counter()
                if len(judged) > 300_000:
                    judged.clear()
                for page_no, doc, page, text in zip(*(c.to_pylist() for c in b.columns)):
                    body = [(i, x.split()) for i, x in enumerate(text.split("\n"), 1)]
                    body = [(i, x) for i, x in body if x]
                    begin = [{"line": i, "word": x[0]} for i, x in body[: EDGE + 1]]
                    rows.append(("n", page_no, doc, page, 0, None, None, None, None, begin))
                    joined_from = False
                    for k, (i, tokens) in enumerate(body):
                        last = tokens[-1]
                        half = last.lstrip(_STRIP)[:-1] if last[-1] in HYPHENS and len(last) > 1 and last[-2].isalpha() else None
                        if half:
                            rows.append(("h", page_no, doc, page, i, None, None, None, half, [{"line": j, "word": x[0]} for j, x in body[k + 1 : k + 2 + EDGE]]))
                        # a first word may be the rest of a word broken on the line before, or on the page before (judged later)
                        inner = tokens[1:] if joined_from else tokens
                        top = not joined_from and k <= EDGE and tokens[0][:1].islower()
                        if half:
                            inner = inner[:-1]
                        for p, t in enumerate(inner):
                            w = judged.get(t)
                            if w is None:
                                w = bare(t)
                                w = judged[t] = "" if w in known and w not in heads or not _LETTER.search(w) or _ODD.search(w) else w
                            if w:
                                # neighbours within the sentence
                                before = bare(inner[p - 1]) if p and inner[p - 1][-1] not in ".;:?!" else None
                                after = bare(inner[p + 1]) if p + 1 < len(inner) and t[-1] not in ".;:?!" else None
                                if w in heads:
                                    beside[w, "b", before] += 1
                                    beside[w, "a", after] += 1
                                    if w in known and w not in asked:
                                        continue
                                rows.append(("c", page_no, doc, page, i, w, before, after, "t" if top and not p else None, None))
                        joined_from = bool(half)
                rows += [("x", None, None, None, n, w, x if side == "b" else None, x if side == "a" else None, side, None) for (w, side, x), n in beside.items() if x]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        return run

    def broken(self) -> DataFrame:
        """(page_no, doc_id, page, line_no, half, tail, next_line, joined): line ends broken by a hyphen that isn't part of the word; next_line is null if the tail is on the next page."""
        first = self.lines.where("kind = 'n'").groupBy("doc_id", "page").agg(F.max_by("next", "page_no").alias("turned"))
        h = self.lines.where("kind = 'h'").select("page_no", "doc_id", "page", "line_no", "half", "next", "next_line")
        h = h.join(first.select("doc_id", (F.col("page") - 1).alias("page"), "turned"), ["doc_id", "page"], "left")
        h = h.withColumn("next", F.coalesce("next", "turned")).withColumn("tail", _unmarked(F.coalesce("next", F.lit(""))))
        h = h.withColumn("joined", F.concat(F.lower("half"), "tail")).withColumn("dashed", F.concat(F.lower("half"), F.lit("-"), "tail"))
        words = self.forms.select("word", "n")
        parts = words.where(F.col("word").contains("-")).select(F.concat(F.element_at(F.split("word", "-"), 1), F.lit("-")).alias("first"), "n").groupBy("first").agg(F.sum("n").alias("firsts"))
        h = h.join(words.select(F.col("word").alias("joined"), F.col("n").alias("whole")), "joined", "left")
        h = h.join(words.select(F.col("word").alias("dashed"), F.col("n").alias("spelt")), "dashed", "left")
        h = h.withColumn("first", F.concat(F.lower("half"), F.lit("-"))).join(parts, "first", "left")
        whole, spelt, firsts = (F.coalesce(c, F.lit(0)) for c in ("whole", "spelt", "firsts"))
        lower = F.col("next").rlike("^\\p{Ll}")
        few = firsts < max(LEAST, KNOWN_FIRST * self.words)
        is_broken = F.when(F.col("next").isNull(), few).when((whole > 0) | (spelt > 0), whole > spelt).otherwise(lower & few)
        return h.where(is_broken).select("page_no", "doc_id", "page", "line_no", "half", "tail", "next_line", "joined")

    def suspects(self, broken: DataFrame) -> DataFrame:
        """(page_no, line_no, word, before, after) of rare and doubtful words, without those that end a word broken on the page before."""
        c = self.lines.where("kind = 'c'").select("page_no", "doc_id", "page", "line_no", "word", "before", "after", "half")
        first = self.lines.where("kind = 'n'").select("page_no", F.col("next_line").alias("line_no"))
        turned = broken.where("next_line is null").select("doc_id", (F.col("page") + 1).alias("page")).distinct()
        rests = c.where("half = 't'").join(first, ["page_no", "line_no"]).join(turned, ["doc_id", "page"]).select("page_no", "line_no")
        top = c.where("half = 't'").join(rests, ["page_no", "line_no"], "left_anti")
        return c.where("half is null").unionByName(top.select(*c.columns)).select("page_no", "line_no", "word", "before", "after")

    def misread(self, broken: DataFrame) -> DataFrame:
        """(page_no, line_no, word, form): misread words of body lines with the form they stand for."""
        c = self.suspects(broken)
        doubtful = self.doubtful.select("word").distinct()
        sure = c.join(self.corrections.join(doubtful, "word", "left_anti").select("word", "form"), "word").select("page_no", "line_no", "word", "form")
        # candidates of a doubtful word: its forms and itself; how often its neighbours stand beside each
        forms = self.doubtful.select("word", "form", "n", "own")
        forms = forms.select("word", "form", "n").unionByName(forms.select("word", F.col("word").alias("form"), F.col("own").alias("n")).distinct())
        x = self.lines.where("kind = 'x'").groupBy("word", "half", F.coalesce("before", "after").alias("beside")).agg(F.sum("line_no").alias("n"))
        left = x.where("half = 'b'").select(F.col("word").alias("form"), F.col("beside").alias("before"), F.col("n").alias("nb"))
        right = x.where("half = 'a'").select(F.col("word").alias("form"), F.col("beside").alias("after"), F.col("n").alias("na"))
        found = c.join(forms, "word").join(left, ["form", "before"], "left").join(right, ["form", "after"], "left")
        itself = F.when(F.col("form") == F.col("word"), 1).otherwise(0)  # the occurrence is no support of its own
        support = F.greatest(F.coalesce("nb", F.lit(0)) - itself, F.lit(0)) + F.greatest(F.coalesce("na", F.lit(0)) - itself, F.lit(0))
        # without support a rare word is taken for its most frequent form, a known one for itself
        known = F.col("own") * SURE > F.col("most")
        rank = F.struct(support.alias("s"), F.when(F.col("form") == F.col("word"), F.when(F.col("known"), F.lit(1 << 60)).otherwise(-1)).otherwise(F.col("n")).alias("n"), "form")
        most = self.doubtful.groupBy("word").agg(F.max("n").alias("most"), F.max("own").alias("own")).select("word", ((F.col("own") >= LEAST) & known).alias("known"))
        best = found.join(most, "word").groupBy("page_no", "line_no", "word", "before", "after").agg(F.max_by("form", rank).alias("form"))
        return sure.unionByName(best.where("form <> word").select("page_no", "line_no", "word", "form"))


def df_words(doubtful: DataFrame) -> frozenset[str]:
    """The words judged by context (of the vocabulary)."""
    return frozenset(r.word for r in doubtful.select("word").distinct().collect())


def line_faults(df: DataFrame) -> DataFrame:
    """(page_no, line_no, kind): every faulty line; kinds header, pageno, hyphen and char."""
    plan = _Plan(df)
    broken = written(plan.broken(), "broken")
    chars = plan.misread(broken).select("page_no", "line_no", F.lit("char").alias("kind"))
    hyphens = broken.select("page_no", "line_no", F.lit("hyphen").alias("kind"))
    # a joined form that never stands unbroken is judged by the same rules
    unseen = broken.groupBy(F.col("joined").alias("word")).agg(F.count("*").alias("n")).join(plan.forms.select("word"), "word", "left_anti")
    sure = plan.corrections.join(plan.doubtful.where(F.col("own") >= LEAST).where(F.col("own") * SURE > F.col("n")).select("word"), "word", "left_anti")  # a word in its own right isn't misread for being broken
    forms = sure.unionByName(corrections(plan.forms, _with_bones(unseen)))
    forms = forms.groupBy(F.col("word").alias("joined")).agg(F.max_by("form", F.struct("n", "form")).alias("form"))
    split_chars = broken.join(forms, "joined").withColumn("late", ~F.endswith("form", "tail"))
    split_chars = written(split_chars.withColumn("early", ~F.startswith("form", F.lower("half")) | ~F.col("late")), "broken-forms")
    char = F.lit("char").alias("kind")
    # the half that differs from the form's start or end holds the fault; the rest stands on the next line, or first on the next page
    first_half = split_chars.where("early").select("page_no", "line_no", char)
    rest = split_chars.where("late and next_line is not null").select("page_no", F.col("next_line").alias("line_no"), char)
    tops = plan.lines.where("kind = 'n' and next is not null").select("doc_id", "page", "page_no", _unmarked("next").alias("tail"), F.col("next_line").alias("line_no"))
    turned = split_chars.where("late and next_line is null").select("doc_id", (F.col("page") + 1).alias("page"), "tail").join(tops, ["doc_id", "page", "tail"]).select("page_no", "line_no", char)
    return plan.edges.unionByName(hyphens).unionByName(chars).unionByName(first_half).unionByName(rest).unionByName(turned).distinct()


def paragraphs(df: DataFrame) -> DataFrame:
    """(doc_id, para_no, text): each document as continuous paragraphs."""
    plan = _Plan(df)
    drop = plan.edges.groupBy("page_no").agg(F.collect_set("line_no").alias("away"))
    broken = written(plan.broken(), "broken")
    joins = broken.groupBy("page_no").agg(F.collect_set("line_no").alias("joins"))
    fixes = plan.misread(broken).groupBy("page_no").agg(F.collect_set(F.struct("word", "form")).alias("fixes"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("page_no")))
    latest = plan.pages.select("page_no", "doc_id", "page").withColumn("r", rank).where("r = 1").select("page_no")
    pages = plan.pages.join(latest, "page_no", "left_semi").join(drop, "page_no", "left").join(joins, "page_no", "left").join(fixes, "page_no", "left")

    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "page", "part", "text", "glue"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for b in batches:
            rows: list[tuple] = []
            for doc, page, text, away, glued, fix in zip(*(c.to_pylist() for c in b.columns)):
                away, glued, fix = set(away or ()), set(glued or ()), {f["word"]: f["form"] for f in fix or ()}
                part, now, glue = 0, "", ""
                lines = text.split("\n")
                for i, line in enumerate(lines, 1):
                    if i in away:
                        continue
                    tokens = [_fixed(t, fix) if bare(t) in fix else t for t in line.split()]
                    if not tokens:
                        if now and not glue and any(x.strip() for k, x in enumerate(lines[i:], i + 1) if k not in away):
                            rows.append((doc, page, part, now, "end"))
                            part, now = part + 1, ""
                        continue
                    joined = " ".join(tokens)
                    now = now + joined if glue or not now else f"{now} {joined}"
                    glue = "cut" if i in glued else ""
                    if glue:
                        now = now[:-1]
                if now:
                    rows.append((doc, page, part, now, glue or ("end" if re.search(r"[.?!:]\W*$", now) else "open")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    parts = pages.select("doc_id", "page", "text", "away", "joins", "fixes").mapInArrow(flow, "doc_id string, page int, part int, text string, glue string")
    order = Window.partitionBy("doc_id").orderBy("page", "part")
    parts = parts.withColumn("before", F.lag("glue").over(order))
    start = F.when(F.col("before").isNull() | (F.col("before") == "end"), 1).otherwise(0)
    parts = parts.withColumn("para_no", F.sum(start).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.struct("page", "part", F.concat(F.when(F.col("before") == "open", " ").otherwise(""), "text").alias("text"))
    # a paragraph that runs on over pages is gathered whole
    return parts.groupBy("doc_id", "para_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x.text), "").alias("text"))


def _fixed(token: str, fix: dict[str, str]) -> str:
    """The token with its bare word replaced by the form, marks and capitals kept."""
    core = token.strip(_STRIP)
    form = fix[core.lower()]
    if core[:1].isupper() or (core[:1] in "0156!" and token != core and core[1:2].isupper()):
        form = form[:1].upper() + form[1:]
    if len(core) > 1 and core.isupper():
        form = form.upper()
    return token.replace(core, form, 1)
