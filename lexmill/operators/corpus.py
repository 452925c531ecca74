"""Repairing a corpus of acts: split run-together sections, drop scraps, keep the longest copy, order."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import leading_int, looks_like_section, trimmed

SKIP, AHEAD, LEAST = 30, 6, 25
_EMBEDDED = re.compile(r"(?:^|[\s\]])(?P<no>[0-9]{1,3}[A-Z]?)\.\s*(?P<note>[A-Z][^.—]{4,90}?)\s*[.—-]{1,2}—")


def run_together(section: str | None, text: str) -> list[tuple[str | None, str]]:
    """(section, text) of each section that a text holds: it is cut where a next number with a note and dash begins."""
    out: list[tuple[str | None, str]] = []
    label, rest = section, text
    number = re.match(r"[0-9]+", label or "")
    while number:
        now = int(number.group())
        cut = None
        for m in _EMBEDDED.finditer(rest):
            to = int(re.match(r"[0-9]+", m["no"]).group())
            if m.start() >= SKIP and now < to <= now + AHEAD:
                cut = m
                break
        if cut is None:
            break
        out.append((label, rest[: cut.start()].strip()))
        label = cut["no"]
        rest = re.sub(rf"^{label}\.\s*", "", rest[cut.start("no") :])
        number = re.match(r"[0-9]+", label)
    out.append((label, rest))
    return out


def exploded(acts: DataFrame) -> DataFrame:
    """(name, pos, section, text): one row a section of an act."""
    return acts.select("name", F.posexplode("sections").alias("pos", "s")).select("name", "pos", "s.section", "s.text")


def repaired(sections: DataFrame) -> DataFrame:
    """(name, pos, part, section, text): sections cut apart, scraps dropped, numbers blanked where the text isn't a section's."""

    def cut(batches):
        for b in batches:
            rows = [(n, p, k, s, t) for n, p, sec, txt in zip(*(c.to_pylist() for c in b.columns)) if txt is not None for k, (s, t) in enumerate(run_together(sec, txt))]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))], ["name", "pos", "part", "section", "text"])

    rows = sections.select("name", "pos", "section", "text").mapInArrow(cut, "name string, pos int, part int, section string, text string")
    rows = rows.withColumn("text", trimmed(F.col("text"))).where(F.length("text") >= LEAST)
    return rows.withColumn("section", F.when(looks_like_section(F.col("text")), trimmed(F.coalesce("section", F.lit("")))).otherwise(""))


def longest(rows: DataFrame) -> DataFrame:
    """One row a numbered section of an act: the longest text, the first of equals; unnumbered rows all stay."""
    order = Window.partitionBy("name", "section").orderBy(F.length("text").desc(), "pos", "part")
    numbered = rows.where("section <> ''").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return numbered.unionByName(rows.where("section = '' or section is null"))


def ordered(rows: DataFrame) -> DataFrame:
    """With the place of each section in its act: by number, then label (in code point order)."""
    order = Window.partitionBy("name").orderBy(F.coalesce(leading_int(F.col("section")), F.lit(0)), "section", "pos", "part")
    return rows.withColumn("place", F.row_number().over(order))


def recovered(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, before, after, recovered): sections of each act before and after repair."""
    a = before.groupBy("name").agg(F.count("*").alias("before"))
    b = after.groupBy("name").agg(F.count("*").alias("after"))
    return a.join(b, "name", "full").na.fill(0, ["before", "after"]).withColumn("recovered", F.col("after") - F.col("before"))


def missing(curated: DataFrame, acts: DataFrame) -> DataFrame:
    return curated.join(acts.select("name").distinct(), "name", "left_anti")


def section_pages(acts: DataFrame) -> DataFrame:
    """(doc_id, unit, section, text): every section as a page, its number before the text where it has one."""
    rows = exploded(acts)
    return rows.select(F.col("name").alias("doc_id"), F.col("pos").alias("unit"), "section", F.when(F.col("section") != "", F.concat(F.lit("Section "), "section", F.lit(". "), "text")).otherwise(F.col("text")).alias("text"))
