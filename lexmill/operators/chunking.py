"""Cutting documents into passages: structure blocks, windows, and the driver that numbers them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import extracted_ref, marginal_note, normalised, trimmed

MIN_CHARS, SPLIT_FACTOR, MIN_BLOCK = 40, 1.35, 120
_WS = r"[\t\n\x0b\f\r    -     　﻿]"
_STRIP = "\t\n\x0b\f\r                  　﻿"
_HEADING = re.compile(
    "|".join(
        (rf"{_WS}*(?:Section|Sec\.|S\.){_WS}*[0-9]+[A-Z]{{0,2}}(?:[.—-]|{_WS})", rf"{_WS}*Article{_WS}*[0-9]+[A-Z]{{0,2}}(?:[.—-]|{_WS})", rf"{_WS}*[0-9]+[A-Z]?\.{_WS}+[A-Z\"'(]", rf"{_WS}*\([0-9]+\){_WS}", rf"{_WS}*(?:CHAPTER|PART){_WS}+[IVXLC0-9]+", rf"{_WS}*[0-9]+(?:\.[0-9]+){{1,3}}{_WS}+(?!{_WS}).")
    ),
    re.I,
)


def structure_blocks(text: str) -> list[str]:
    """Blocks that begin at heading lines; a heading opens a block only behind one of over MIN_BLOCK characters."""
    blocks: list[str] = []
    begin = at = 0
    for line in text.split("\n"):
        # the block so far is text[begin:at - 1]
        if at > begin and _HEADING.match(line) and len(text[begin : at - 1].strip(_STRIP)) > MIN_BLOCK:
            blocks.append(text[begin : at - 1])
            begin = at
        at += len(line) + 1
    blocks.append(text[begin:])
    return [b for b in blocks if b.strip(_STRIP)]


def windows(text: str, size: int, overlap: int, lossless: bool = False) -> list[str]:
    """Windows that end at a sentence where one ends in their last quarter; lossless: the next begins no later than this one ends."""
    if len(text) <= size:
        return [text]
    step, quarter = max(120, size - overlap), size // 4
    out, begin = [], 0
    while begin < len(text):
        end = min(begin + size, len(text))
        if end < len(text):
            found = max(text.rfind(mark, end - quarter, end) for mark in (". ", ".\n", "\n\n"))
            if found > end - quarter:
                end = found + 1
        piece = text[begin:end].strip(_STRIP)
        if piece:
            out.append(piece)
        if end >= len(text):
            break
        after = max(begin + step, end - overlap)
        begin = min(after, end) if lossless else after
    return out


def chunks(units: DataFrame, size: int = 1800, overlap: int = 100, structure: bool = False, lossless: bool = False) -> DataFrame:
    """Passages of units (doc_id, unit, text; unit is a page or 0): doc_id, ordinal, chunk_id, unit, text, ref, heading."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, nos, places, texts, blocks_of = [], [], [], [], []
            for doc, no, text in zip(*(c.to_pylist() for c in b.columns)):
                place = 0
                for block in structure_blocks(text) if structure else [text]:
                    for piece in windows(block, size, overlap, lossless) if len(block) > size * SPLIT_FACTOR else [block]:
                        piece = piece.strip(_STRIP)
                        if len(piece) >= MIN_CHARS:
                            docs.append(doc), nos.append(no), places.append(place), texts.append(piece), blocks_of.append(block[:400])
                            place += 1
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field(0).type), pa.array(nos, pa.int32()), pa.array(places, pa.int32()), pa.array(texts, pa.string()), pa.array(blocks_of, pa.string())], ["doc_id", "unit", "place", "text", "block"])

    doc = units.schema["doc_id"].dataType.simpleString()
    clean = units.select("doc_id", F.col("unit").cast("int").alias("unit"), normalised(F.col("text")).alias("text")).where("text <> ''")
    made = clean.mapInArrow(cut, f"doc_id {doc}, unit int, place int, text string, block string")
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("unit", "place")) - 1
    made = made.withColumn("ordinal", ordinal)
    return made.select("doc_id", "ordinal", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("ordinal").cast("string")).alias("chunk_id"), "unit", "text", extracted_ref(F.col("text")).alias("ref"), marginal_note(F.col("block")).alias("heading"))


def stamped(made: DataFrame, sections: DataFrame) -> DataFrame:
    """Passages of acts with the section number of their unit as reference (sections: doc_id, unit, section)."""
    ref = F.when(F.col("section") != "", F.concat(F.lit("S. "), "section"))
    return made.drop("ref").join(sections.select("doc_id", "unit", "section"), ["doc_id", "unit"], "left").withColumn("ref", ref).drop("section", "unit")


def length_percentiles(df: DataFrame, text: str = "text", points: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Nearest-rank percentiles of text lengths: the value at place floor(n * p) + 1, and the largest.

    Lengths are counted first, so the running sum goes over distinct lengths only.
    """
    counts = df.where(F.col(text).isNotNull()).groupBy(F.length(text).alias("chars")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    running = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("chars").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", running).withColumn("total", total)
    values = [F.min(F.when(F.col("upto") >= F.floor(F.col("total") * p) + 1, F.col("chars"))).alias(f"p{int(p * 100)}") for p in points]
    return ranked.agg(*values, F.max("chars").alias("longest"))


def trimmed_length(c):
    return F.length(trimmed(c))
