"""Problem 4: groups of near-duplicate texts, without comparing all pairs.

Method: meet-in-the-middle ball hashing. A text's fingerprint in each of ``TABLES`` tables is a block of
its signature: a code of ``BITS`` one-bit min-wise values of its three-word runs under an anchor of ``SYMBOLS`` whole values. Every fingerprint
emits all variants of its code within half the radius (``RADIUS`` 2, so the code and each of its one-bit changes); two
fingerprints of an anchor whose codes differ in up to RADIUS bits meet in a variant, all others never do. Rows are shuffled once, on the part that
all variants of a fingerprint share (the anchor), and the variants are emitted behind the shuffle while the
sorted rows stream by. Colliding pairs are verified on their 64-bit signatures, deduplicated and verified exactly on their texts.

At similarity 0.7 a pair meets in at least one table with probability 0.9986, at 0.75 0.9999; its signatures differ in over ``SIGNATURE_BITS`` bits with
probability 0.001 at 0.7. Texts with the same words (case and look-alikes aside) are one class: only its smallest key takes part, so copies cost nothing.
A task holds at most ``HELD`` rows of an anchor; rows of longer runs are streamed on and meet in a second, skew-split shuffle on
(anchor, variant), by the same rule, so no pair is lost at any size.

Null texts and texts under ``MIN_WORDS`` words are never part of a pair. Repeated keys aren't expected (the key must be unique).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.canonical import _digest, one_form
from lexmill.llm.common import written

MIN_WORDS, RUN, THRESHOLD = 20, 3, 0.7
VALUES, TABLES, SYMBOLS, BITS, RADIUS, HELD = 64, 20, 3, 10, 2, 200_000
#: Bits of the signature that may differ: at 0.7 on average 9.6 of 64 do (deviation 2.9), at chance 31.
SIGNATURE_BITS = 18

_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(1, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
#: Of each table: the values of its anchor, and the values whose bits make its code.
_PICKS = [_rng.permutation(VALUES)[: SYMBOLS + BITS] for _ in range(TABLES)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    """Hash of each word; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        h = self[word] = int.from_bytes(_digest(word)[:8], "little")
        return h


_words = _Words()


def words_of(text: str) -> list[str]:
    """The words of a text: runs of non-blank characters of its one form, case aside."""
    return one_form(text).lower().split()


def run_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of the three-word runs, in order."""
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    return _mixed(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9))


def similarity(a: str, b: str) -> float:
    """Distinct three-word runs in both texts over those in either."""
    x, y = (set(zip(w, w[1:], w[2:])) for w in (words_of(a), words_of(b)))
    return len(x & y) / len(x | y) if x or y else 0.0


def sketches(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(key, class_hash, signature, anchors) of every text of at least MIN_WORDS words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                b = big.slice(at, 2000)
                if len(_words) > 500_000:
                    _words.clear()
                kept, classes, hashes = [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    words = words_of(t)
                    if len(words) >= MIN_WORDS:
                        kept.append(i)
                        classes.append(_digest(" ".join(words)))
                        hashes.append(run_hashes(words))
                if not kept:
                    continue
                starts = np.concatenate([[0], np.cumsum([len(h) for h in hashes])[:-1]])
                x = (np.concatenate(hashes) >> np.uint64(32)).astype(np.uint32)
                low = np.stack([np.minimum.reduceat(x * a, starts) for a in _ODD], 1)
                mixed = _mixed(low.astype(np.uint64) + (np.arange(VALUES, dtype=np.uint64) << np.uint64(32)))
                bit = mixed >> np.uint64(63)
                signature = (bit << np.arange(VALUES, dtype=np.uint64)).sum(1, dtype=np.uint64)
                anchors = np.empty((len(kept), TABLES), np.uint64)
                for t, pick in enumerate(_PICKS):
                    anchor = np.full(len(kept), t + 1, np.uint64)
                    for k in pick[:SYMBOLS]:
                        anchor = _mixed(anchor * np.uint64(0x9E3779B97F4A7C15) + mixed[:, k])
                    anchors[:, t] = anchor
                ends = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * TABLES)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(kept)),
                        pa.array(classes, pa.binary()),
                        pa.array(signature.view(np.int64)),
                        pa.ListArray.from_arrays(ends, pa.array(anchors.ravel().view(np.int64))),
                    ],
                    ["key", "class_hash", "signature", "anchors"],
                )

    rows = df.select(F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())
    kind = df.schema[key_col].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, class_hash binary, signature long, anchors array<long>")


#: What turns a code into its variants: all changes of up to half the radius.
_CHANGES = np.array([sum(1 << i for i in c) for h in range(RADIUS // 2 + 1) for c in combinations(range(BITS), h)], np.int64)
_CODE_BITS = np.array([pick[SYMBOLS:] for pick in _PICKS], np.uint64)


def codes(table: np.ndarray, signature: np.ndarray) -> np.ndarray:
    """The code of each row's table, read off its signature."""
    bits = (signature.view(np.uint64)[:, None] >> _CODE_BITS[table]) & np.uint64(1)
    return (bits << np.arange(BITS, dtype=np.uint64)).sum(1, dtype=np.uint64).astype(np.int64)


def meeting(group: np.ndarray, code: np.ndarray, signature: np.ndarray, changes: np.ndarray = _CHANGES) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the rows that share a group and a variant of their codes and have close signatures, each pair once."""
    n = len(group)
    at = np.tile(np.arange(n), len(changes))
    variant = ((group << BITS) | code)[at] ^ np.repeat(changes, n)
    order = np.argsort(variant, kind="stable")
    variant, at = variant[order], at[order]
    got: list[np.ndarray] = []
    first = np.flatnonzero(variant[1:] == variant[:-1])
    lag = 1
    while len(first):  # rows of a variant stand side by side: pairs by their distance
        i, j = at[first], at[first + lag]
        close = np.bitwise_count((signature[i] ^ signature[j]).view(np.uint64)) <= SIGNATURE_BITS
        i, j = i[close], j[close]
        got.append(np.minimum(i, j) * n + np.maximum(i, j))
        if len(got) > 64:
            got = [np.unique(np.concatenate(got))]
        lag += 1
        first = first[first + lag < len(variant)]
        first = first[variant[first] == variant[first + lag]]
    pairs = np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64)
    return pairs // n, pairs % n


def colliding(classes: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of classes that meet in a variant of a fingerprint and whose signatures are close."""
    prints = classes.select("key", "signature", F.posexplode("anchors").alias("tab", "anchor"))
    kind = classes.schema["key"].dataType.simpleString()
    tables = prints.repartition("anchor").sortWithinPartitions("anchor")
    held = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "anchor", "tab", "signature"]

        def found(part: pa.Table) -> pa.RecordBatch:
            anchor, tab, signature = (part[c].to_numpy() for c in ("anchor", "tab", "signature"))
            begin = np.r_[True, anchor[1:] != anchor[:-1]]
            alone = begin & np.r_[begin[1:], True]
            rows = np.flatnonzero(~alone)  # an anchor of one text emits nothing
            group = np.cumsum(begin)[rows]
            i, j = meeting(group, codes(tab[rows], signature[rows]), signature[rows])
            keys = part["key"].combine_chunks().take(pa.array(rows))
            x, y = keys.take(pa.array(i)), keys.take(pa.array(j))
            less = pc.less(x, y)
            n = len(i)
            return pa.RecordBatch.from_arrays([pc.if_else(less, x, y), pc.if_else(less, y, x), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names)

        def streamed(part: pa.Table) -> pa.RecordBatch:
            keys = part["key"].combine_chunks()
            return pa.RecordBatch.from_arrays([keys, pa.nulls(len(keys), keys.type), *(part[c].combine_chunks() for c in ("anchor", "tab", "signature"))], names)

        waiting: list[pa.Table] = []
        size, hot = 0, None
        for b in batches:
            t = pa.Table.from_batches([b])
            while t.num_rows:
                anchor = t["anchor"].to_numpy()
                if hot is not None:  # the rest of a run that was too long
                    n = int(np.argmax(anchor != hot)) if (anchor != hot).any() else len(anchor)
                    if n:
                        yield streamed(t.slice(0, n))
                    t = t.slice(n)
                    hot = hot if not t.num_rows else None
                    continue
                waiting.append(t)
                size += t.num_rows
                t = t.slice(0, 0)
                if size < held:
                    break
                whole = pa.concat_tables(waiting)
                anchor = whole["anchor"].to_numpy()
                if anchor[0] == anchor[-1]:
                    hot = anchor[0]
                    yield streamed(whole)
                    waiting, size = [], 0
                else:  # whole runs are done, the last may go on
                    last = len(anchor) - int(np.argmax((anchor != anchor[-1])[::-1]))
                    yield found(whole.slice(0, last))
                    waiting = [whole.slice(last)]
                    size = waiting[0].num_rows
        if size:
            yield found(pa.concat_tables(waiting))

    rows = written(tables.select("key", "signature", F.col("tab").cast("int").alias("tab"), "anchor").mapInArrow(run, f"a {kind}, b {kind}, anchor long, tab int, signature long"), "met")
    code = lambda bits: F.expr(" + ".join(f"shiftleft(shiftrightunsigned(signature, {k}) & 1L, {i})" for i, k in enumerate(bits)))
    by_table = F.coalesce(*(F.when(F.col("tab") == t, code(pick[SYMBOLS:])) for t, pick in enumerate(_PICKS)))
    long = rows.where("anchor is not null").withColumn("code", by_table)
    long = long.select("anchor", F.explode(F.array(*(F.col("code").bitwiseXOR(F.lit(int(c))) for c in _CHANGES))).alias("variant"), F.col("a").alias("key"), "signature")
    left, right = long.alias("l"), long.alias("r")
    close = F.expr(f"bit_count(l.signature ^ r.signature) <= {SIGNATURE_BITS}")
    met = left.join(right, ["anchor", "variant"]).where((F.col("l.key") < F.col("r.key")) & close)
    return rows.where("anchor is null").select("a", "b").unionByName(met.select(F.col("l.key").alias("a"), F.col("r.key").alias("b"))).distinct()


def near_classes(df: DataFrame, key_col: str = "chunk_no", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Membership (key, class) and links (a, b, similarity) between the classes' smallest keys, at the threshold or above."""
    rows = written(sketches(df, key_col, text_col), "sketches")
    classes = rows.groupBy("class_hash").agg(F.min(F.struct("key", "signature", "anchors")).alias("c"))
    # copies are pre-aggregated; the join back splits a class that a third of the rows share
    members = rows.select("class_hash", "key").join(rows.groupBy("class_hash").agg(F.min("key").alias("class")), "class_hash").select("key", "class")
    pairs = written(colliding(classes.select("c.*")), "colliding")
    texts = df.select(F.col(key_col).alias("k"), F.col(text_col).alias("t"))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    texts = written(texts.join(needed, "k", "left_semi"), "texts")
    both = pairs.join(texts.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p = p.assign(similarity=[similarity(x, y) for x, y in zip(p.ta, p.tb)])
            yield p.loc[p.similarity >= threshold, ["a", "b", "similarity"]]

    kind = df.schema[key_col].dataType.simpleString()
    links = both.select("a", "b", "ta", "tb").mapInPandas(verify, f"a {kind}, b {kind}, similarity double")
    return members, links


def near_pairs(df: DataFrame, key_col: str = "chunk_no", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(a, b), a < b: all pairs of rows at the threshold or above, copies included."""
    members, links = near_classes(df, key_col, text_col, threshold)
    links = written(links, "links")
    pair = F.struct(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    left = members.select(F.col("class").alias("a"), F.col("key").alias("x"))
    right = members.select(F.col("class").alias("b"), F.col("key").alias("y"))
    across = links.select("a", "b").join(left, "a").join(right, "b").select(pair.alias("p"))
    copies = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    twins = members.join(copies, "class", "left_semi")
    inside = twins.select("class", F.col("key").alias("x")).join(twins.select("class", F.col("key").alias("y")), "class").where("x < y").select(pair.alias("p"))
    return across.unionByName(inside).select("p.a", "p.b")


def classes_with_links(df: DataFrame, key_col: str = "chunk_no", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a text of enough words: key, class (smallest key of its copies), links (number of other classes at the threshold or above)."""
    members, links = near_classes(df, key_col, text_col, threshold)
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(ends, "class", "left").select(F.col("key").alias(key_col), "class", F.coalesce("links", F.lit(0)).alias("links"))

