"""Problem 8: encode every text with a byte-level BPE vocabulary.

Method: pair occurrence index. The distinct pre-tokens of a batch are laid out as one
symbol array with successor/predecessor links. Every mergeable pair is mapped to the list of
all its positions; active ranks are applied in ascending order, each rank merging all its
positions at once, and only the lists of the pairs created by a merge are updated.

Texts are cut into blank-led units first (a pre-token never crosses the place before a single
blank), so a unit met again in a worker costs one dictionary look-up.

Null and empty texts both encode to an empty list. Texts that look like special tokens are
ordinary text. Repeated rows are encoded each. Only the id and the text column are read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import TOKENIZER_DIR

#: Pre-token pattern of the vocabulary (a fixed value: other patterns give other ids).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
#: Units kept by a worker before its table is started anew (bounds memory, not results).
MAX_UNITS = 300_000
_SHIFT = np.int64(1 << 20)


class PairIndexBPE:
    """Byte-level BPE over a rank file, by pair occurrence index."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_id = np.zeros(256, np.int64)
        for b in range(256):
            self.byte_id[b] = ranks[bytes([b])]
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a = ranks.get(token[:k])
                if a is not None:
                    b = ranks.get(token[k:])
                    if b is not None:
                        left.append(a)
                        right.append(b)
                        rank.append(r)
        keys = np.array(left, np.int64) * _SHIFT + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(rank, np.int64)[order]
        self.split = regex.compile(PATTERN).findall
        self.reset()

    def reset(self) -> None:
        self.pre: dict[str, np.ndarray] = {}
        self.units: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair; -1 where it can't merge."""
        key = left * _SHIFT + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def merge_all(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each of the byte strings."""
        joined = b"".join(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        # one slot of -1 after every piece, so that no pair crosses two pieces
        total = int(sizes.sum()) + len(pieces) + 1
        sym = np.full(total, -1, np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) + 1
        inside = np.ones(total, bool)
        inside[0] = False
        inside[begin + sizes] = False
        sym[inside] = self.byte_id[np.frombuffer(joined, np.uint8)]
        nxt, prv = np.arange(1, total + 1), np.arange(-1, total - 1)
        nxt[-1] = total - 1
        first = self.rank_of(sym[:-1], sym[1:])
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        index: dict[int, list[np.ndarray]] = {}
        if len(at):
            r = first[at]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for part, rank in zip(np.split(at, cuts), r[np.concatenate([[0], cuts])]):
                index[int(rank)] = [part]
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank, None)
            if lists is None:
                continue
            pos = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            # a position is stale if its symbol was swallowed or its pair has changed
            pos = pos[self.rank_of(sym[pos], sym[nxt[pos]]) == rank]
            if not len(pos):
                continue
            right = nxt[pos]
            if np.isin(right, pos).any():  # overlapping occurrences (aaa): leftmost first
                keep, last = [], -1
                for p, q in zip(pos.tolist(), right.tolist()):
                    if p != last:
                        keep.append(p)
                        last = q
                if len(keep) < len(pos):
                    heapq.heappush(active, rank)
                    index[rank] = [np.setdiff1d(pos, keep)]
                pos = np.array(keep, np.int64)
                right = nxt[pos]
            after = nxt[right]
            sym[pos] = rank
            sym[right] = -2
            nxt[pos] = after
            prv[after] = pos
            for left in (prv[pos], pos):
                left = left[left >= 0]
                new = self.rank_of(sym[left], sym[nxt[left]])
                ok = new >= 0
                left, new = left[ok], new[ok]
                if len(left):
                    order = np.argsort(new, kind="stable")
                    left, new = left[order], new[order]
                    cuts = np.flatnonzero(np.diff(new)) + 1
                    for part, k in zip(np.split(left, cuts), new[np.concatenate([[0], cuts])].tolist()):
                        if k in index:
                            index[k].append(part)
                        else:
                            index[k] = [part]
                            heapq.heappush(active, k)
        live = sym >= 0
        ids = sym[live].astype(np.int32)
        ends = np.cumsum(live)
        stop, start = ends[begin + sizes - 1], ends[begin - 1]
        return [ids[a:b] for a, b in zip(start.tolist(), stop.tolist())]

    def _add_units(self, units: list[str]) -> None:
        """Append units (already numbered in ``self.units``) to the id table."""
        parts = [self.split(u) for u in units]
        new = [p for p in dict.fromkeys(p for ps in parts for p in ps) if p not in self.pre]
        if new:
            self.pre.update(zip(new, self.merge_all([p.encode("utf-8", "surrogatepass") for p in new])))
        pre = self.pre
        ids = [pre[ps[0]] if len(ps) == 1 else np.concatenate([pre[p] for p in ps]) if ps else np.zeros(0, np.int32) for ps in parts]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        n0, n1, need = len(self.units) - len(units), len(self.units), self.used + int(size.sum())
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        if ids:
            self.flat[self.used : need] = np.concatenate(ids)
        self.size[n0:n1] = size
        self.start[n0:n1] = self.used + np.cumsum(size) - size
        self.used = need

    def _numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Unit number of each unit of each text, and the number of units of each text."""
        if len(self.units) > MAX_UNITS:
            self.reset()
        units, flat, count = self.units, [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if not t:
                continue
            if "  " in t or "\x00" in t:  # a run of blanks may be one pre-token: no unit boundary inside it
                us = self.split(t)
            else:
                us = t.replace(" ", "\x00 ").split("\x00")
                if not us[0]:
                    del us[0]
            count[i] = len(us)
            flat += us
        fresh = [u for u in dict.fromkeys(flat) if u not in units]
        if fresh:
            units.update(zip(fresh, range(len(units), len(units) + len(fresh))))
            self._add_units(fresh)
        return np.fromiter(map(units.__getitem__, flat), np.int64, len(flat)), count

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the end offset (with a leading 0) of each text."""
        unit, count = self._numbered(texts)
        size = self.size[unit]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.start[unit] - (ends - size), size) + np.arange(total)
        per_unit = np.concatenate([[0], ends])
        offsets = per_unit[np.concatenate([[0], np.cumsum(count)])]
        return self.flat[source], offsets

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        unit, count = self._numbered(texts)
        ends = np.concatenate([[0], np.cumsum(self.size[unit])])
        return np.diff(ends[np.concatenate([[0], np.cumsum(count)])])


@lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexBPE:
    """The worker's encoder; Spark reuses workers, so its tables live across tasks."""
    return PairIndexBPE(path)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """One row (id, ids) for each row; [] for null and empty texts. Other columns are not carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for b in batches:
            flat, offsets = bpe.encode(b.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["__id", "ids"])

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("__id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
    return out.withColumnRenamed("__id", id_col)


def count_tokens(df: DataFrame, keep: list[str], text_col: str = "text", out_col: str = "tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` and the number of ids of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for b in batches:
            n = pa.array(bpe.count(b.column(b.num_columns - 1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], [*keep, out_col])

    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keep), T.StructField(out_col, T.LongType())])
    return df.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
