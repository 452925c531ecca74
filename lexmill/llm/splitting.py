"""Problem 6: cut oversized texts into ordered, overlapping pieces at natural boundaries.

Method: byte-range processing. A text (a giant file, or a table's value) is cut into byte ranges; workers find
the natural boundaries that begin in their range, with a halo of one byte before it (a boundary split over two ranges is seen once) and of
one piece behind it (a piece may end in the next range). Each range counts its characters, and prefix sums over the ranges give
every boundary its offset in the text. Where a range's first piece begins depends on the range before it: so a range states, for every place
where a piece may begin, where the next range's first piece then begins and how many pieces that makes; these tables are composed
up a tree of ``FAN`` ranges a node and the entries handed down again, so no task sees more than FAN tables of a file of any size. Pieces are
emitted by offset, each range reading its own bytes only; no worker loads a whole file. A table's value is in its worker's memory
already: its ranges are scanned and stitched there, in one pass over the table without a shuffle.

A natural boundary is a line feed, or a plain blank right after one of ``. ; : ? !``. Pieces hold at
most ``limit`` characters (code points); where no boundary lies within reach a piece is cut at the limit (forced). The next
piece starts ``overlap`` characters before the cut, moved to a boundary inside the overlap where there is one.

Null and empty texts and texts within the limit have no stretch (``boundary_gaps``) and one whole piece
(``split_pieces``; null gives none). An empty file has no piece. Repeated rows are cut each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import shared_dir, written

LIMIT, OVERLAP = 1200, 120
#: Bytes of a range, of a table's value and of a file; ranges of a node of the tree.
RANGE, FILE_RANGE, FAN = 1 << 16, 1 << 22, 64
_BOUNDARY = re.compile(rb"\n|(?<=[.;:?!]) ")


class Range:
    """The characters and boundaries of a byte range and its halos; offsets count characters from the range's first."""

    __slots__ = ("ends", "final", "lead", "limit", "overlap", "own", "raw", "start")

    def __init__(self, read: Callable[[int, int], bytes], start: int, size: int, total: int, limit: int, overlap: int) -> None:
        back = 1 if start else 0
        ahead = 4 * limit + 4  # a character has up to four bytes
        self.raw = read(start - back, back + min(size + ahead, total - start))
        lead = np.flatnonzero((np.frombuffer(self.raw, np.uint8) & 0xC0) != 0x80)
        self.lead = np.append(lead[lead >= back], len(self.raw))  # byte of each character, and the end
        self.own = int(np.searchsorted(self.lead[:-1], back + size))  # characters that begin in the range itself
        found = [m.end() for m in _BOUNDARY.finditer(self.raw, back)]
        self.ends = np.searchsorted(self.lead, found).tolist()  # a piece may end just behind a boundary
        self.final = len(self.lead) - 1 if start + size + ahead >= total else None
        self.start, self.limit, self.overlap = start, limit, overlap

    def step(self, at: int) -> tuple[int, int, str]:
        """(end, next start, cut) of the piece that starts at a place; the last piece has no next start (-1)."""
        if self.final is not None and self.final - at <= self.limit:
            return self.final, -1, "end"
        k = bisect_right(self.ends, at + self.limit) - 1
        natural = k >= 0 and self.ends[k] > at + self.overlap
        end = self.ends[k] if natural else at + self.limit
        back = max(end - self.overlap, at + 1)
        j = bisect_left(self.ends, back)
        after = self.ends[j] if self.overlap and j < len(self.ends) and self.ends[j] < end else back
        return end, after, "natural" if natural else "forced"

    def pieces(self, entry: int) -> Iterator[tuple[int, int, str]]:
        """(start, end, cut) of the pieces that start in the range, from the entry on."""
        at = entry
        while 0 <= at < self.own:
            end, after, cut = self.step(at)
            yield at, end, cut
            at = after

    def exits(self) -> tuple[list[int], list[int]]:
        """For every entry under the limit: the entry of the next range (-1: the text is over) and the number of pieces."""
        known: dict[int, tuple[int, int]] = {}
        for entry in range(self.limit):
            path, at = [], entry
            while 0 <= at < self.own and at not in known:
                path.append(at)
                at = self.step(at)[1]
            to, n = known[at] if at in known else (at - self.own if at >= 0 else -1, 0)
            for k, x in enumerate(reversed(path), 1):
                known[x] = to, n + k
            if entry >= self.own:
                known[entry] = to, n
        return [known[e][0] for e in range(self.limit)], [known[e][1] for e in range(self.limit)]

    def bytes_of(self, start: int, end: int) -> bytes:
        return self.raw[self.lead[start] : self.lead[end]]


def _ranges(data: bytes, limit: int, overlap: int, size: int) -> Iterator[tuple[int, Range]]:
    """(offset, range) of the ranges of a value in memory, offsets by prefix sums."""
    offset = 0
    for start in range(0, len(data), size):
        r = Range(lambda at, n: data[at : at + n], start, size, len(data), limit, overlap)
        yield offset, r
        offset += r.own


def longest_stretch(text: str, limit: int = LIMIT, size: int = RANGE) -> int:
    """The longest stretch without a boundary: the ranges' boundary tables stitched by their offsets."""
    before, longest, total = 0, 0, 0
    for offset, r in _ranges(text.encode("utf-8", "surrogatepass"), limit, 0, size):
        ends = np.asarray(r.ends, np.int64)
        ends = ends[ends <= r.own] + offset  # those behind it are the next range's
        if len(ends):
            longest = max(longest, int(np.diff(ends, prepend=before).max()) - 1)
            before = int(ends[-1])
        total = offset + r.own
    return max(longest, total - before)


def text_pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> list[tuple[int, int, str]]:
    """(start, end, cut) of the pieces of a text: every range is entered where the one before it was left."""
    if len(text) <= limit:
        return [(0, len(text), "whole")]
    out: list[tuple[int, int, str]] = []
    entry = 0
    for offset, r in _ranges(text.encode("utf-8", "surrogatepass"), limit, overlap, size):
        at = entry
        while 0 <= at < r.own:
            end, after, cut = r.step(at)
            out.append((offset + at, offset + end, cut))
            at = after
        if at < 0:
            break
        entry = at - r.own
    return out


def boundary_gaps(df: DataFrame, id_col: str = "chunk_no", text_col: str = "text", limit: int = LIMIT, range_size: int = RANGE) -> DataFrame:
    """(id, longest_stretch, cut) of every oversized text: natural if no stretch between boundaries is over the limit, else forced."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            longest = [longest_stretch(t, limit, range_size) for t in b.column(1).to_pylist()]
            cut = ["natural" if n <= limit else "forced" for n in longest]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(longest, pa.int64()), pa.array(cut, pa.string())], [id_col, "longest_stretch", "cut"])

    long = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > limit)
    return long.mapInArrow(run, f"`{id_col}` {kind}, longest_stretch long, cut string")


def split_pieces(
    df: DataFrame, id_col: str = "chunk_no", text_col: str = "text", carry: tuple[str, ...] = ("heading",), limit: int = LIMIT, overlap: int = OVERLAP, range_size: int = RANGE
) -> DataFrame:
    """Ordered pieces: id, carried columns, piece_no (from 0), piece_start, piece (text), cut ('natural', 'forced', 'end' or 'whole')."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    carried = [F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)]
    rows = df.select(F.col(id_col).alias("id"), *carried, F.col(text_col).cast("string").alias("text")).where("text is not null")
    fields = ", ".join([f"id {df.schema[id_col].dataType.simpleString()}", *(f"__c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for first in range(0, big.num_rows, 500):
                b = big.slice(first, 500)
                at, no, start, piece, cuts = [], [], [], [], []
                for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                    for k, (lo, hi, cut) in enumerate(text_pieces(text, limit, overlap, range_size)):
                        at.append(i), no.append(k), start.append(lo), piece.append(text[lo:hi]), cuts.append(cut)
                kept = [c.take(pa.array(at, pa.int32())) for c in b.columns[:-1]]
                made = [pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(piece, pa.string()), pa.array(cuts, pa.string())]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*b.schema.names[:-1], "piece_no", "piece_start", "piece", "cut"])

    out = rows.mapInArrow(run, f"{fields}, piece_no int, piece_start int, piece string, cut string")
    return out.select(F.col("id").alias(id_col), *(F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)), "piece_no", "piece_start", "piece", "cut")


def _reader(path: str) -> tuple[Callable[[int, int], bytes], Callable[[], None]]:
    """What reads bytes of a file on any file system the workers share, and what closes it."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    f = system.open_input_file(inner)
    return lambda at, n: f.read_at(n, at), f.close


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, range_size: int = FILE_RANGE) -> DataFrame:
    """Pieces (path, piece_no, piece_start, piece BINARY, cut) of UTF-8 files of any size on a shared file system.

    The driver knows the files' names and sizes only. Pieces are cut between characters, and joined without their overlaps they are the file.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    from pyarrow import fs

    sizes = {}
    for p in paths:
        system, inner = fs.FileSystem.from_uri(p if "://" in p else f"file://{p}")
        sizes[p] = system.get_file_info(inner).size
    counts = {p: -(-n // range_size) for p, n in sizes.items() if n}
    if not counts:
        return spark.createDataFrame([], "path string, piece_no long, piece_start long, piece binary, cut string")
    files = spark.createDataFrame([(p, sizes[p], n) for p, n in counts.items()], "path string, total long, ranges long")
    ranges = files.select("path", "total", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("no")).repartition(min(sum(counts.values()), 4096), "path", "no")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, total, no in b.itertuples(index=False):
                read, close = _reader(path)
                r = Range(read, no * range_size, range_size, total, limit, overlap)
                close()
                to, n = r.exits()
                yield pd.DataFrame({"path": [path], "total": [total], "no": [no], "own": [r.own], "to": [to], "n": [n]})

    def compose(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """The table of FAN ranges as one."""
        group = group.sort_values("no")
        to, n = np.arange(limit), np.zeros(limit, np.int64)
        for t, c in zip(group["to"], group["n"]):
            on = to >= 0
            n[on] += np.asarray(c, np.int64)[to[on]]
            to[on] = np.asarray(t, np.int64)[to[on]]
        return pd.DataFrame({"path": [key[0]], "no": [key[1]], "own": [group["own"].sum()], "to": [to], "n": [n]})

    table = "path string, no long, own long, to array<long>, n array<long>"
    leaves = written(ranges.mapInPandas(scan, "path string, total long, no long, own long, to array<long>, n array<long>"), "ranges")
    levels, most = [leaves.drop("total")], max(counts.values())
    while most > 1:
        up = levels[-1].groupBy("path", F.floor(F.col("no") / FAN).alias("up")).applyInPandas(compose, table)
        most = -(-most // FAN)
        levels.append(written(up, "ranges"))

    def hand_down(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """Entry, offset and first piece of each range of a node, from those of the node."""
        group = group.sort_values("no")
        entry, offset, piece = int(group["entry"].iloc[0]), int(group["offset"].iloc[0]), int(group["piece"].iloc[0])
        rows = []
        for no, own, to, n in zip(group["no"], group["own"], group["to"], group["n"]):
            rows.append((key[0], no, entry, offset, piece))
            offset += own
            if entry >= 0:
                entry, piece = int(to[entry]), piece + int(n[entry])
        return pd.DataFrame(rows, columns=["path", "no", "entry", "offset", "piece"])

    entries = levels[-1].select("path", "no", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("piece"))
    for level in reversed(levels[:-1]):
        above = entries.withColumnRenamed("no", "up")
        below = level.withColumn("up", F.floor(F.col("no") / FAN)).join(above, ["path", "up"])
        entries = below.groupBy("path", "up").applyInPandas(hand_down, "path string, no long, entry long, offset long, piece long")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, total, no, entry, offset, piece in b.itertuples(index=False):
                read, close = _reader(path)
                r = Range(read, no * range_size, range_size, total, limit, overlap)
                close()
                got = [(path, piece + k, offset + lo, r.bytes_of(lo, hi), "whole" if cut == "end" and not piece + k else cut) for k, (lo, hi, cut) in enumerate(r.pieces(entry))]
                yield pd.DataFrame(got, columns=["path", "piece_no", "piece_start", "piece", "cut"])

    todo = leaves.select("path", "total", "no").join(entries.where("entry >= 0"), ["path", "no"]).select("path", "total", "no", "entry", "offset", "piece")
    return todo.mapInPandas(emit, "path string, piece_no long, piece_start long, piece binary, cut string")


def write_files(df: DataFrame, name_col: str, text_col: str, folder: str) -> DataFrame:
    """Write each row's text as a file of the shared folder; (name, path). Names must be unique; null texts give no file."""
    root = f"{shared_dir(df.sparkSession)}/{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            names, at = b.column(0).to_pylist(), []
            for name, text in zip(names, b.column(1).to_pylist()):
                path = f"{root}/{hashlib.sha1(name.encode()).hexdigest()}.txt"
                system, inner = fs.FileSystem.from_uri(path)
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(inner) as f:
                    f.write(text.encode("utf-8", "surrogatepass"))
                at.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(at, pa.string())], ["name", "path"])

    rows = df.select(F.col(name_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text")).where("name is not null and text is not null")
    return rows.mapInArrow(run, "name string, path string")
